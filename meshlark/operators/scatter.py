"""Periodic scatter and gather over a stencil: explode, modular key, join, grouped sum."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import settled
from .relations import attach, traced

CELLS = ("ix", "iy", "iz")
Support = Sequence[int] | Sequence[tuple[int, int, int]]
Outputs = Mapping[str, Column]


def expand_support(support: Support) -> list[tuple[tuple[int, int, int], tuple[int, int, int]]]:
    """``(index, offset)`` of every stencil point.  A 1-D support spans a cube, x outermost; an N x 3 one is taken as it is."""
    points = list(support)
    if points and all(isinstance(p, int) for p in points):
        n = range(len(points))
        return [((i, j, k), (points[i], points[j], points[k])) for i in n for j in n for k in n]
    if not points or any(isinstance(p, int) or len(p) != 3 for p in points):
        raise ValueError("a support is a sequence of integers or of integer triples")
    return [((i, i, i), tuple(p)) for i, p in enumerate(points)]


@dataclass
class Stencil:
    """What a kernel sees of one stencil point: its index and offset per axis, and the grids' values there."""

    index: tuple[Column, Column, Column]
    offset: tuple[Column, Column, Column]
    grid: dict[str, Column] = field(default_factory=dict)

    def pick(self, arrays: Sequence[str]) -> Column:
        """The product of one element per axis out of array columns computed before the stencil is expanded."""
        return F.get(arrays[0], self.index[0]) * F.get(arrays[1], self.index[1]) * F.get(arrays[2], self.index[2])


Kernel = Callable[[Stencil], tuple[Outputs | None, Outputs | None]]


def route(points: DataFrame, *relations: tuple[DataFrame, str]) -> DataFrame:
    """Adds routed keys: each relation is joined on the named column, in turn, so that one may index the next."""
    for relation, key in relations:
        points = points.join(relation, key)
    return points


def row_columns(points: DataFrame) -> list[str]:
    """The columns that tell points apart, as far as they can be grouped by."""
    return [f.name for f in points.schema if isinstance(f.dataType, T.AtomicType)]


def scatter_over_support(
    points: DataFrame, support: Support, kernel: Kernel, grid_shape: Sequence[int], cell: Sequence[str] = ("cx", "cy", "cz"), batch: Sequence[str] = (),
    grids: Mapping[str, tuple[DataFrame, Sequence[str]]] | None = None, point_key: Sequence[str] | None = (),
) -> tuple[DataFrame | None, DataFrame | None]:
    """Evaluate ``kernel`` at every stencil point of every row of ``points`` and sum what it returns.

    ``cell`` names integer columns of any sign; cells are taken modulo
    ``grid_shape``.  ``grids`` maps a name to ``(relation, keys)``: the relation
    has ``ix iy iz``, the key columns and ``value``; a missing cell is 0.  The
    kernel may read any ``Relation`` as well, by columns of ``points`` or cells.
    Its first mapping is summed per ``batch`` and cell, by default over all
    batches; its second per ``point_key`` and ``batch`` -- columns of ``points``,
    routed before if need be; None is every column of them.

    A kernel that returns both is evaluated once: one stencil, one join per
    grid, and one shuffle of partial sums by either key.
    """
    if len(grid_shape) != 3 or any(int(n) < 1 for n in grid_shape):
        raise ValueError("a grid has three positive dimensions")
    if len(cell) != 3:
        raise ValueError("a cell has three coordinates")
    if point_key is None:
        point_key = row_columns(points)
    stencil = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("jx", "jy", "jz", "ox", "oy", "oz"), (*i, *o))]) for i, o in expand_support(support)])
    values = {name: F.coalesce(F.col(f"_grid_{name}"), F.lit(0.0)) for name in grids or {}}
    seen = Stencil(tuple(F.col(f"_s.j{a}") for a in "xyz"), tuple(F.col(f"_s.o{a}") for a in "xyz"), values)
    result, read = traced(kernel, seen)
    if not isinstance(result, tuple) or len(result) != 2:
        raise ValueError("a kernel returns grid outputs and outputs")
    on_grid, per_point = result
    # What is keyed by the points is joined while they are few.
    early = {r: c for r, c in read.items() if set(r.keys) <= set(points.columns)}
    spread = attach(points, early).withColumn("_s", F.explode(stencil))
    for key, c, o, n in zip(CELLS, cell, ("ox", "oy", "oz"), grid_shape):
        spread = spread.withColumn(key, F.pmod(F.col(c) + F.col(f"_s.{o}"), F.lit(int(n))).cast("int"))
    for name, (relation, keys) in (grids or {}).items():
        missing = {*CELLS, *keys, "value"} - set(relation.columns)
        if missing:
            raise ValueError(f"grid {name} lacks {sorted(missing)}")
        spread = spread.join(relation.select(*CELLS, *keys, F.col("value").alias(f"_grid_{name}")), [*CELLS, *keys], "left")
    spread = attach(spread, {r: c for r, c in read.items() if r not in early})
    sums = lambda outputs: [F.sum(c).alias(n) for n, c in outputs.items()]
    cell_key, own_key = [*batch, *CELLS], list(dict.fromkeys([*point_key, *batch]))
    if not on_grid or not per_point:
        return spread.groupBy(*cell_key).agg(*sums(on_grid)) if on_grid else None, spread.groupBy(*own_key).agg(*sums(per_point)) if per_point else None
    every = list(dict.fromkeys([*cell_key, *own_key]))
    outputs = {f"_g_{n}": c for n, c in on_grid.items()} | {f"_p_{n}": c for n, c in per_point.items()}
    rows = spread.select(*every, *(c.alias(n) for n, c in outputs.items()))
    both = rows.groupingSets([[F.col(c) for c in cell_key], [F.col(c) for c in own_key]], *(F.col(c) for c in every)).agg(F.grouping("ix").alias("_point"), *(F.sum(n).alias(n) for n in outputs))
    both = settled(both, "scattered")
    part = lambda point, key, pre, names: both.where(F.col("_point") == point).select(*key, *(F.col(pre + n).alias(n) for n in names))
    return part(0, cell_key, "_g_", on_grid), part(1, own_key, "_p_", per_point)


def scatter_to_mesh(points: DataFrame, support: Support, kernel: Callable[[Stencil], Outputs], grid_shape: Sequence[int], **more) -> DataFrame:
    """Spread only: the kernel's values summed per batch and cell."""
    return scatter_over_support(points, support, lambda s: (kernel(s), None), grid_shape, **more)[0]


def gather_from_mesh(points: DataFrame, support: Support, kernel: Callable[[Stencil], Outputs], grid_shape: Sequence[int], **more) -> DataFrame:
    """Interpolation only: the kernel's values summed per point."""
    return scatter_over_support(points, support, lambda s: (None, kernel(s)), grid_shape, **more)[1]
