"""Derivatives of the two primitives both ways, for kernels written in ``functions.graph``, and their transposes.

A kernel gets a Node per input column and grid value and returns Nodes.  Its
tangents come out of the same stencil or spectrum as its values.  Backwards,
spreading and gathering change places: cotangents of grids become grids that are
gathered from, and grids that were gathered from become outputs that are spread
to.  A transform's adjoint is its inverse, but for the number of cells, which
cancels.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import graph
from ..functions.complex import Complex
from ..functions.graph import Node
from .relations import Relation
from .scatter import CELLS, Stencil, Support, gather_from_mesh, scatter_over_support
from .spectral import inverse_dft, map_spectrum, spectra

Nodes = Mapping[str, Node]
#: ``kernel(stencil, inputs, grids)`` returns grid outputs and outputs.
NodeKernel = Callable[[Stencil, Nodes, Nodes], tuple[Nodes | None, Nodes | None]]
#: ``fn(frequencies, values)`` returns grids and sums; the parts of all complex values are Nodes.
NodeMap = Callable[..., tuple[Mapping[str, Complex] | None, Mapping[str, Complex] | None]]
Tables = Mapping[str, tuple[DataFrame, Sequence[str]]]


def _columns(nodes: Nodes) -> dict[str, Column]:
    return {n: x.column for n, x in nodes.items()}


def scatter_jvp(
    points: DataFrame, support: Support, kernel: NodeKernel, inputs: Sequence[str], grid_shape: Sequence[int], tangents: Mapping[str, str],
    grids: Tables | None = None, grid_tangents: Tables | None = None, **more,
) -> tuple[DataFrame | None, DataFrame | None]:
    """``scatter_over_support`` of ``kernel``, with ``<output>_tangent`` beside every output that can change.

    ``tangents`` names a column of ``points`` for inputs that move,
    ``grid_tangents`` a table for grids that do; all others stand still.
    """
    tables = dict(grids or {}) | {f"tangent_{g}": t for g, t in (grid_tangents or {}).items()}

    def run(s: Stencil):
        leaves = {c: graph.leaf(F.col(c)) for c in inputs}
        fields = {g: graph.leaf(s.grid[g]) for g in grids or {}}
        moving = {leaves[c]: F.col(t) for c, t in tangents.items()} | {fields[g]: s.grid[f"tangent_{g}"] for g in grid_tangents or {}}
        outputs = []
        for side in kernel(s, leaves, fields):
            found = graph.forward(side or {}, moving)
            outputs.append(side and _columns(side) | {f"{n}_tangent": x.column for n, x in found.items()})
        return tuple(outputs)

    return scatter_over_support(points, support, run, grid_shape, grids=tables or None, **more)


def scatter_vjp(
    points: DataFrame, support: Support, kernel: NodeKernel, inputs: Sequence[str], grid_shape: Sequence[int], grid_cotangents: Tables | None = None,
    cotangents: Mapping[str, str] | None = None, grids: Tables | None = None, grid_keys: Sequence[str] = (), point_key: Sequence[str] | None = None, **more,
) -> tuple[DataFrame | None, DataFrame | None]:
    """Cotangents of the grids, per ``grid_keys`` and cell, and of the inputs, per ``point_key``.

    ``grid_cotangents`` gives a table (with ``value``) for grid outputs,
    ``cotangents`` a column of ``points`` for the others; an output without one
    does not count.  Columns are named as what they are the cotangents of; an
    input or grid that no counted output depends on has none.
    """
    tables = dict(grids or {}) | {f"cotangent_{g}": t for g, t in (grid_cotangents or {}).items()}

    def run(s: Stencil):
        leaves = {c: graph.leaf(F.col(c)) for c in inputs}
        fields = {g: graph.leaf(s.grid[g]) for g in grids or {}}
        on_grid, per_point = kernel(s, leaves, fields)
        counted = [(on_grid[n], s.grid[f"cotangent_{n}"]) for n in grid_cotangents or {}] + [(per_point[n], F.col(c)) for n, c in (cotangents or {}).items()]
        found = graph.backward(counted, {f"g_{n}": x for n, x in fields.items()} | {f"i_{n}": x for n, x in leaves.items()})
        side = lambda pre: {n[2:]: x.column for n, x in found.items() if n.startswith(pre)} or None
        return side("g_"), side("i_")

    return scatter_over_support(points, support, run, grid_shape, grids=tables or None, batch=grid_keys, point_key=point_key, **more)


def _node_values(values: Mapping[str, Complex], names: Sequence[str]) -> dict[str, Complex]:
    return {v: Complex(*map(graph.leaf, values[v])) for v in names}


def _parts(values: Mapping[str, Complex] | None) -> dict[str, Node]:
    return {f"{v}_{p}": Node.of(getattr(x, p)) for v, x in (values or {}).items() for p in ("re", "im")}


def _complex(parts: Nodes, names: Sequence[str], suffix: str = "") -> dict[str, Complex]:
    """Those names of which a part is there; the other part may be known to be zero."""
    part = lambda v, p: parts[f"{v}_{p}"].column if f"{v}_{p}" in parts else F.lit(0.0)
    return {v + suffix: Complex(part(v, "re"), part(v, "im")) for v in names if {f"{v}_re", f"{v}_im"} & set(parts)}


def spectral_jvp(
    fn: NodeMap, grid: DataFrame, grid_shape: Sequence[int], names: Sequence[str], tangents: Mapping[str, str], sign: int = -1, keys: Sequence[str] = (),
    is_hermitian: bool = False, aux_keys: Sequence[str] = (), aux: Mapping[str, Relation] | None = None,
) -> tuple[DataFrame | None, DataFrame | None]:
    """``spectral_map`` of ``fn``, with ``<output>_tangent`` beside every output that can change.

    ``tangents`` names other grids of the table for those of ``names`` that move.
    """
    moving = list(dict.fromkeys(tangents.values()))
    spectrum, keys = spectra([(grid, [*names, *moving], keys)], grid_shape, dict.fromkeys([*names, *moving], sign), is_hermitian)

    def run(i, values, *more):
        leaves = _node_values(values, names)
        seeds = {getattr(leaves[v], p): getattr(values[t], p) for v, t in tangents.items() for p in ("re", "im")}
        sides = []
        for side in fn(i, leaves, *more):
            parts = _parts(side)
            sides.append(_complex(parts, list(side), "") | _complex(graph.forward(parts, seeds), list(side), "_tangent") if side else None)
        return tuple(sides)

    mapped, sums = map_spectrum(run, spectrum, grid_shape, [*names, *moving], keys, is_hermitian, aux, aux_keys)
    if mapped is None:
        return None, sums
    outputs = [c.removesuffix("_re") for c in mapped.columns if c.endswith("_re") and c not in keys]
    return inverse_dft(mapped, grid_shape, outputs, sign, keys, is_hermitian), sums


def spectral_vjp(
    fn: NodeMap, grid: DataFrame, grid_shape: Sequence[int], names: Sequence[str], grid_cotangents: Mapping[str, str] | None = None, aux_cotangents: Mapping[str, Relation | float] | None = None,
    sign: int = -1, keys: Sequence[str] = (), is_hermitian: bool = False, aux: Mapping[str, Relation] | None = None,
) -> DataFrame:
    """Cotangents of the grids ``names`` for those of what ``fn`` returns, both by real and imaginary parts.

    ``grid_cotangents`` names other grids of the table for grid outputs,
    ``aux_cotangents`` a number or a relation with ``re`` and ``im`` for sums.
    Complex cotangents pair with tangents as ``Re(conj(cotangent) tangent)``.
    Maps may be of any form: several names, mixed, not linear.
    """
    given = list(dict.fromkeys((grid_cotangents or {}).values()))
    spectrum, keys = spectra([(grid, [*names, *given], keys)], grid_shape, dict.fromkeys([*names, *given], sign), is_hermitian)
    cells = float(grid_shape[0] * grid_shape[1] * grid_shape[2])

    def run(i, values, *more):
        leaves = _node_values(values, names)
        grids, sums = (_parts(side) for side in fn(i, leaves, *more))
        counted = [(grids[f"{v}_{p}"], getattr(values[t], p) / F.lit(cells)) for v, t in (grid_cotangents or {}).items() for p in ("re", "im")]
        for v, c in (aux_cotangents or {}).items():
            parts = ("re",) if is_hermitian else ("re", "im")
            counted += [(sums[f"{v}_{p}"], c[p] if isinstance(c, Relation) else F.lit(float(c) if p == "re" else 0.0)) for p in parts]
        found = graph.backward(counted, _parts(leaves))
        none = {f"{v}_re": graph.Node.of(0) for v in names}
        return {v: x.scale(F.lit(cells)) for v, x in _complex(none | found, names).items()}, None

    mapped, _ = map_spectrum(run, spectrum, grid_shape, [*names, *given], keys, is_hermitian, aux)
    # By weights of the half spectrum the sums that led here were taken; the way back takes the same ones.
    return inverse_dft(mapped, grid_shape, names, sign, keys, is_hermitian)


def scatter_transpose(points: DataFrame, support: Support, weight: Callable[[Stencil], Column], cotangent: DataFrame, grid_shape: Sequence[int], batch: Sequence[str] = (), point_key: Sequence[str] = (), **more) -> DataFrame:
    """The transpose of spreading ``weight(stencil) * feature``: a gather of the grid's ``value`` with the same weights."""
    return gather_from_mesh(points, support, lambda s: {"value": weight(s) * s.grid["g"]}, grid_shape, grids={"g": (cotangent, batch)}, point_key=point_key, **more)


def linear_transpose(
    fn: NodeMap, cotangent: DataFrame, grid_shape: Sequence[int], names: Sequence[str], outputs: Mapping[str, str], sign: int = -1, keys: Sequence[str] = (), aux: Mapping[str, Relation] | None = None,
) -> DataFrame:
    """The transpose of a spectral map that is linear in ``names``: for tables x and y, the sums of ``y * map(x)`` and ``transposed(y) * x`` agree.

    ``outputs`` names a grid of ``cotangent`` for each of the map's grids.  The
    map may mix names and need be neither real nor even; what is not linear is
    taken at zero.
    """
    turn = lambda df, vs: df.select(*keys, *CELLS, *(c for v in vs for c in (F.col(f"{v}_re"), (-F.col(f"{v}_im")).alias(f"{v}_im"))))
    flipped = turn(cotangent, list(dict.fromkeys(outputs.values())))
    zero = {f"{v}_{p}": F.lit(0.0) for v in names for p in ("re", "im")}
    if set(zero) & set(flipped.columns):
        raise ValueError("cotangents have names of their own")
    return turn(spectral_vjp(fn, flipped.withColumns(zero), grid_shape, names, outputs, None, sign, keys, False, aux), names)


def spectral_transpose(multiplier: Callable[[tuple[Column, Column, Column]], Complex], cotangent: DataFrame, grid_shape: Sequence[int], names: Sequence[str], sign: int = -1, keys: Sequence[str] = ()) -> DataFrame:
    """The transpose of multiplying a spectrum: ``linear_transpose`` of that."""
    given = {v: f"cotangent_{v}" for v in names}
    renamed = cotangent.select(*keys, *CELLS, *(F.col(f"{v}_{p}").alias(f"{c}_{p}") for v, c in given.items() for p in ("re", "im")))
    fn = lambda i, values: ({v: x * Complex(*map(Node.of, multiplier(i))) for v, x in values.items()}, None)
    return linear_transpose(fn, renamed, grid_shape, names, given, sign, keys)
