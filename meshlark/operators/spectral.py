"""Spectral map: separable discrete Fourier transform, an expression per frequency, weighted sums, inverse."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.complex import Complex
from .relations import Relation, attach, traced
from .scatter import CELLS

#: Values that a task of a transform holds at once.
BLOCK = 1 << 22


def _pencils(axis: str, n: int, names: Sequence[str], keys: Sequence[str], transform: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """Transforms whole pencils, many at once, and returns a row for each of their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, step := max(1, BLOCK // (n * len(names)))):
                part = batch.slice(begin, step)
                cells = part.column("pencil")
                row = np.repeat(np.arange(part.num_rows), cells.value_lengths().to_numpy(zero_copy_only=False))
                cell = cells.flatten()
                place = row * n + cell.field("at").to_numpy(zero_copy_only=False)
                out = {}
                for v in names:
                    whole = np.zeros(part.num_rows * n, complex)
                    np.add.at(whole, place, cell.field(f"{v}_re").to_numpy(zero_copy_only=False) + 1j * cell.field(f"{v}_im").to_numpy(zero_copy_only=False))
                    done = transform(whole.reshape(-1, n))
                    out[f"{v}_re"], out[f"{v}_im"] = done.real.ravel(), done.imag.ravel()
                width = done.shape[1]
                again = pa.array(np.repeat(np.arange(part.num_rows), width))
                columns = {c: part.column(c).take(again) for c in keys}
                columns[axis] = pa.array(np.tile(np.arange(width, dtype=np.int32), part.num_rows))
                columns |= {c: pa.array(x) for c, x in out.items()}
                yield pa.RecordBatch.from_arrays([columns[c] for c in (*keys, axis, *out)], [*keys, axis, *out])

    return run


def _pass(grid: DataFrame, axis: str, n: int, names: Sequence[str], keys: Sequence[str], transform: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Transforms one axis: its pencils, of n cells at most each, are gathered and go through a fast transform of any length.

    One shuffle of the grid's cells, n log n steps a pencil; no task holds more
    than a block of pencils.
    """
    rest = [*keys, *(x for x in CELLS if x != axis)]
    values = [f"{v}_{p}" for v in names for p in ("re", "im")]
    cell = F.struct(F.col(axis).alias("at"), *(F.col(c).cast("double").alias(c) for c in values))
    pencils = grid.groupBy(*rest).agg(F.collect_list(cell).alias("pencil"))
    schema = T.StructType([*(grid.schema[c] for c in rest), T.StructField(axis, T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in values)])
    return pencils.mapInArrow(_pencils(axis, n, names, rest, transform), schema).select(*keys, *CELLS, *values)


def _forward(n: int, sign: int, half: bool) -> Callable[[np.ndarray], np.ndarray]:
    upto = n // 2 + 1 if half else n
    return lambda x: (np.fft.fft(x, axis=1) if sign < 0 else np.fft.ifft(x, axis=1, norm="forward"))[:, :upto]


def _from_half(n: int, sign: int) -> Callable[[np.ndarray], np.ndarray]:
    """Real values of a half axis, of which n cells are there but n/2 + 1 hold anything; not normalised."""
    return lambda x: np.fft.irfft((x if sign < 0 else x.conj())[:, : n // 2 + 1], n, axis=1, norm="forward") + 0j


def dft(grid: DataFrame, grid_shape: Sequence[int], names: Sequence[str], sign: int = -1, keys: Sequence[str] = (), half: bool = False) -> DataFrame:
    """Transform of ``<name>_re``, ``<name>_im`` over ``ix iy iz`` per ``keys``, without normalisation.

    Missing cells are 0.  ``half`` keeps the frequencies 0 to n/2 of the last
    axis, which are all there is to know of real values.
    """
    if sign not in (-1, 1):
        raise ValueError("the sign of a transform is -1 or +1")
    nx, ny, nz = grid_shape
    out = _pass(grid, "iz", nz, names, keys, _forward(nz, sign, half))
    out = _pass(out, "iy", ny, names, keys, _forward(ny, sign, False))
    return _pass(out, "ix", nx, names, keys, _forward(nx, sign, False))


def half_weight(iz: Column, nz: int) -> Column:
    """How often a frequency of the half spectrum stands for one of the whole."""
    own = (iz == 0) | (iz == nz // 2) if nz % 2 == 0 else iz == 0
    return F.when(own, F.lit(1.0)).otherwise(F.lit(2.0))


def inverse_dft(spectrum: DataFrame, grid_shape: Sequence[int], names: Sequence[str], sign: int = -1, keys: Sequence[str] = (), half: bool = False) -> DataFrame:
    """Undoes ``dft`` of the same sign; from a half spectrum the values are real and ``_im`` is 0."""
    nx, ny, nz = grid_shape
    out = _pass(spectrum, "ix", nx, names, keys, _forward(nx, -sign, False))
    out = _pass(out, "iy", ny, names, keys, _forward(ny, -sign, False))
    out = _pass(out, "iz", nz, names, keys, _from_half(nz, sign) if half else _forward(nz, -sign, False))
    scale = F.lit(1.0 / (nx * ny * nz))
    return out.select(*keys, *CELLS, *((F.col(f"{v}_{p}") * scale).alias(f"{v}_{p}") for v in names for p in ("re", "im")))


def frequency(cell: Column, n: int, half: bool = False) -> Column:
    """Signed frequency of a cell; the middle of an even axis is negative on a whole axis and positive on a half one."""
    return cell if half else F.when(cell < (n + 1) // 2, cell).otherwise(cell - n)


Values = Mapping[str, Complex]
Map = Callable[..., tuple[Values | None, Values | None]]
#: A grid of its own: the table, the names of its values, and its batch keys.
Grid = tuple[DataFrame, Sequence[str], Sequence[str]]


def spectra(grids: Sequence[Grid], grid_shape: Sequence[int], signs: Mapping[str, int], half: bool) -> tuple[DataFrame, list[str]]:
    """The spectra of all grids side by side, and their batch keys together.

    A grid that lacks a key of another one is the same for all its batches.
    """
    met, met_keys = None, []
    for table, names, keys in grids:
        for s in sorted({signs[v] for v in names}):
            own = dft(table, grid_shape, [v for v in names if signs[v] == s], s, keys, half)
            met = own if met is None else met.join(own, [*(k for k in keys if k in met_keys), *CELLS])
            met_keys += [k for k in keys if k not in met_keys]
    return met, met_keys


def map_spectrum(
    fn: Map, spectrum: DataFrame, grid_shape: Sequence[int], names: Sequence[str], keys: Sequence[str] = (), is_hermitian: bool = False,
    aux: Mapping[str, Relation] | None = None, aux_keys: Sequence[str] = (), grid_keys: Sequence[str] | None = None,
) -> tuple[DataFrame | None, DataFrame | None]:
    """``spectral_map`` of what has been transformed already; its grids stay spectra, reduced to ``grid_keys``."""
    at = tuple(frequency(F.col(c), n, is_hermitian and c == "iz") for c, n in zip(CELLS, grid_shape))
    values = {v: Complex(F.col(f"{v}_re"), F.col(f"{v}_im")) for v in names}
    (grids, sums), read = traced(fn, at, values, *([aux] if aux else []))
    met = attach(spectrum, read)
    keys, many = list(keys), any(r.many for r in read)
    kept = keys if grid_keys is None else list(grid_keys)
    if set(kept) - set(keys):
        raise ValueError("grid_keys are some of the batch keys")
    mapped = summed = None
    if grids:
        parts = {f"{v}_{p}": getattr(x, p) for v, x in grids.items() for p in ("re", "im")}
        if many or set(kept) != set(keys):
            # Transforms are linear: batches are added before they are transformed back.
            mapped = met.groupBy(*kept, *CELLS).agg(*(F.sum(x).alias(c) for c, x in parts.items()))
        else:
            mapped = met.select(*kept, *CELLS, *(x.alias(c) for c, x in parts.items()))
    if sums:
        weight = half_weight(F.col("iz"), grid_shape[2]) if is_hermitian else F.lit(1.0)
        terms = [F.sum(x.re * weight).alias(f"{v}_re") for v, x in sums.items()] + [F.sum(x.im).alias(f"{v}_im") for v, x in sums.items() if not is_hermitian]
        summed = met.groupBy(*aux_keys).agg(*terms)
    return mapped, summed


def spectral_map(
    fn: Map, grid: DataFrame | Sequence[Grid], grid_shape: Sequence[int], names: Sequence[str] = (), sign: int | Mapping[str, int] = -1, keys: Sequence[str] = (),
    is_hermitian: bool = False, aux_keys: Sequence[str] = (), aux: Mapping[str, Relation] | None = None, grid_keys: Sequence[str] | None = None, real: bool = False,
) -> tuple[DataFrame | None, DataFrame | None]:
    """Transform, map every frequency, transform back; and sum per-frequency values.

    ``fn(frequencies, values)`` gets signed integer frequencies and a complex
    value per name, and returns mappings of complex values: grids, which are
    transformed back per ``grid_keys``, and auxiliaries, which are summed per
    ``aux_keys``.  With ``aux`` it is called as ``fn(frequencies, values, aux)``;
    these relations, and any that it closes over, are joined by frequency, batch
    or nothing.

    ``grid`` is a table with ``names`` and ``keys``, or a list of such triples,
    whose batches meet on the keys they share.  ``grid_keys`` are some of all
    keys, by default all of them; over the others grids are added, before one
    transform back.  With ``is_hermitian`` the grids are real, the half spectrum
    is mapped, auxiliaries count by ``half_weight`` and only their real part is
    meant; ``real`` then leaves out the imaginary zeros of the grids.  ``sign``
    may differ per name.
    """
    grids_in = [(grid, names, keys)] if isinstance(grid, DataFrame) else list(grid)
    names = [v for _, own, _ in grids_in for v in own]
    signs = {v: sign if isinstance(sign, int) else sign[v] for v in names}
    spectrum, keys = spectra(grids_in, grid_shape, signs, is_hermitian)
    mapped, sums = map_spectrum(fn, spectrum, grid_shape, names, keys, is_hermitian, aux, aux_keys, grid_keys)
    if mapped is None:
        return None, sums
    kept = [c for c in mapped.columns if c in keys]
    outputs = [c.removesuffix("_re") for c in mapped.columns if c.endswith("_re") and c not in kept]
    direction = {v: signs.get(v, next(iter(signs.values()))) for v in outputs}
    back = None
    for s in sorted(set(direction.values())):
        own = inverse_dft(mapped, grid_shape, [v for v in outputs if direction[v] == s], s, kept, is_hermitian)
        back = own if back is None else back.join(own, [*kept, *CELLS])
    return back.drop(*(f"{v}_im" for v in outputs)) if real and is_hermitian else back, sums
