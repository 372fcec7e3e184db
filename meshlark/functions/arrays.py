"""Operations on small arrays inside a row; indices count from zero."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a result, times those folded into each, up to which it is written out as expressions that Spark compiles; lambdas are interpreted.
WRITTEN = 256
#: Elements folded into one, up to which they are written out: a function that reads its sum twice doubles the expression with each.
WRITTEN_FOLD = 4


def iota(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")


def at(a: Column, i: Column | int) -> Column:
    return F.get(a, F.lit(i) if isinstance(i, int) else i)


def bound(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` of values that are computed once a row, however often it reads them; Spark shares nothing inside lambdas.

    Plain columns are read where they are, so that what is made of them can be compiled.
    """
    if not values:
        return body()
    if re.fullmatch(r"Column<'\w+'>", repr(values[0])):
        return bound(lambda *rest: body(values[0], *rest), *values[1:])
    return F.get(F.transform(F.array(values[0]), lambda x: bound(lambda *rest: body(x, *rest), *values[1:])), F.lit(0))


def take(a: Column, indices: Sequence[int]) -> Column:
    return bound(lambda v: F.array(*[at(v, i) for i in indices]), a)


def slice_(a: Column, start: int, stop: int, stride: int = 1) -> Column:
    return take(a, range(start, stop, stride))


def transpose(a: Column, rows: int, cols: int) -> Column:
    """Of a row-major array of ``rows`` times ``cols``."""
    return take(a, [r * cols + c for c in range(cols) for r in range(rows)])


def concatenate(*parts: Column) -> Column:
    return F.concat(*parts)


def broadcast_rows(a: Column, n: int) -> Column:
    """An array repeated along a new first axis."""
    return F.array_repeat(a, n)


def broadcast_cols(a: Column, n: int) -> Column:
    """Every element repeated along a new last axis."""
    return F.transform(a, lambda x: F.array_repeat(x, n))


def sort_with(less: Callable[[Column, Column], Column], *fields: Column) -> list[Column]:
    """Sorts arrays together by a comparator of their rows, structs with fields ``f0``, ``f1``, ...; equal rows keep their order."""
    rows = F.arrays_zip(*(f.alias(f"f{i}") for i, f in enumerate(fields)), F.transform(fields[0], lambda _, i: i).alias("at"))
    order = F.array_sort(rows, lambda a, b: F.when(less(a, b), -1).when(less(b, a), 1).otherwise(a["at"] - b["at"]))
    pick = lambda name: F.transform(order, lambda r: r[name])
    return [pick(f"f{i}") for i in range(len(fields))]


def reduce_rows(start: Column, combine: Callable[[Column, Column], Column], *fields: Column) -> Column:
    """Folds several arrays at once: ``combine`` takes the struct so far and a row with fields ``f0``, ``f1``, ..."""
    return F.aggregate(F.arrays_zip(*(f.alias(f"f{i}") for i, f in enumerate(fields))), start, combine)


def batched_dot(a: Column, b: Column) -> Column:
    """Products of pairs of vectors, for arrays of vectors."""
    return F.zip_with(a, b, dot)


def pad(a: Column, n: int, value: Column, low: int = 0, high: int = 0, interior: int = 0) -> Column:
    """Pads an array of ``n``; negative padding cuts."""
    inner = [i for k in range(n) for i in ([k] + [None] * (interior if k < n - 1 else 0))]
    full = [None] * max(low, 0) + inner[max(-low, 0) : len(inner) - max(-high, 0)] + [None] * max(high, 0)
    return bound(lambda v: F.array(*[value if i is None else at(v, i) for i in full]), a)


def dynamic_slice(a: Column, start: Column, n: int, size: int) -> Column:
    """``size`` elements of ``n`` from ``start``, which is moved into range."""
    return F.slice(a, F.least(F.greatest(start, F.lit(0)), F.lit(n - size)) + 1, F.lit(size))


def dynamic_update(a: Column, part: Column, start: Column, n: int, size: int) -> Column:
    begin = F.least(F.greatest(start, F.lit(0)), F.lit(n - size)).cast("int")
    return bound(lambda p, b: F.transform(a, lambda x, i: F.when((i >= b) & (i < b + size), F.get(p, i - b)).otherwise(x)), part, begin)


def gather(a: Column, indices: Column, n: int) -> Column:
    """Elements at ``indices``, which are moved into range."""
    return bound(lambda v: F.transform(indices, lambda i: F.get(v, F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)))), a)


def scatter(a: Column, indices: Column, updates: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Combines updates into elements one after another; indices out of range are dropped."""
    pairs = F.arrays_zip(indices.alias("i"), updates.alias("u"))
    return bound(lambda met: F.transform(a, lambda x, k: F.aggregate(F.filter(met, lambda p: p["i"] == k), x, lambda acc, p: combine(acc, p["u"]))), pairs)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def matmul(a: Column, b: Column, n: int, k: int, m: int) -> Column:
    """Row-major ``n`` times ``k`` by ``k`` times ``m``."""
    return dot_general(a, b, (n, k), (k, m), ((1,), (0,)))


def reduce(a: Column, start: Column, combine: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, start, combine)


def reduce_window(a: Column, n: int, size: int, start: Column, combine: Callable[[Column, Column], Column], stride: int = 1, dilation: int = 1, low: int = 0, high: int = 0) -> Column:
    """Folds windows of an array of ``n``; places outside are skipped."""
    span = (size - 1) * dilation + 1

    def folded(v: Column) -> Column:
        out = []
        for begin in range(-low, n + high - span + 1, stride):
            acc = start
            for i in range(begin, begin + span, dilation):
                acc = combine(acc, at(v, i)) if 0 <= i < n else acc
            out.append(acc)
        return F.array(*out)

    return bound(folded, a)


def sort_by(keys: Column, *values: Column) -> list[Column]:
    """Sorts by ascending keys, equal ones in the order they had; returns the keys and the values so ordered."""
    fields = [keys, *values]
    rows = F.arrays_zip(keys.alias("k"), F.transform(keys, lambda _, i: i).alias("at"))
    order = F.array_sort(rows)
    pick = lambda f: bound(lambda v: F.transform(order, lambda r: F.get(v, r["at"])), f)
    return [pick(f) for f in fields]


# -- arrays of any number of axes, kept flat in row-major order -------------------

Shape = Sequence[int]


def strides(shape: Shape) -> list[int]:
    """How far apart neighbours along each axis are."""
    out = [1] * len(shape)
    for i in reversed(range(len(shape) - 1)):
        out[i] = out[i + 1] * shape[i + 1]
    return out


def places(shape: Shape, axes: Sequence[int], steps: Sequence[int] | None = None) -> list[int]:
    """Where the elements along ``axes`` lie, in row-major order of these axes; ``steps`` are the strides if they aren't the array's own."""
    own, out = steps or strides(shape), [0]
    for a in axes:
        out = [base + i * own[a] for base in out for i in range(shape[a])]
    return out


def _numbers(values: Sequence[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<int>")


def _each(places_: Sequence[int], element: Callable[[Column], Column]) -> Column:
    """``element`` of every number."""
    return F.array(*[element(F.lit(i)) for i in places_]) if 0 < len(places_) <= WRITTEN else F.transform(_numbers(places_), element)


def _folds(sets: Sequence[Sequence[int]], start: Column, combine: Callable[[Column, Column], Column], element: Callable[[Column], Column]) -> Column:
    """For every set of numbers, ``element`` of each combined in their order."""
    longest = max(map(len, sets), default=0)
    if longest > WRITTEN_FOLD or longest * len(sets) > WRITTEN:
        return F.transform(F.array(*map(_numbers, sets)), lambda w: F.aggregate(w, start, lambda acc, i: combine(acc, element(i))))
    out = []
    for numbers in sets:
        acc = start
        for i in numbers:
            acc = combine(acc, element(F.lit(i)))
        out.append(acc)
    return F.array(*out)


def _rest(shape: Shape, axes: Sequence[int]) -> list[int]:
    if len(set(axes)) != len(axes) or not set(axes) <= set(range(len(shape))):
        raise ValueError("axes are different numbers of axes")
    return [a for a in range(len(shape)) if a not in axes]


def permute(a: Column, shape: Shape, order: Sequence[int]) -> Column:
    """The array with its axes in another order."""
    return bound(lambda v: _each(places(shape, order), lambda i: at(v, i)), a)


def broadcast_in_dim(a: Column, shape: Shape, to: Shape, axes: Sequence[int]) -> Column:
    """Spreads an array over a larger shape: its axis ``i`` becomes ``axes[i]``, of the same size unless it had size 1."""
    own, steps = strides(shape), [0] * len(to)
    for i, axis in enumerate(axes):
        if shape[i] not in (1, to[axis]):
            raise ValueError("an axis is spread only from size 1")
        steps[axis] = own[i] if shape[i] > 1 else 0
    return bound(lambda v: _each(places(to, range(len(to)), steps), lambda i: at(v, i)), a)


def dot_general(
    a: Column, b: Column, a_shape: Shape, b_shape: Shape, contract: tuple[Sequence[int], Sequence[int]], batch: tuple[Sequence[int], Sequence[int]] = ((), ()),
    zero: Column | None = None, times: Callable[[Column, Column], Column] = lambda x, y: x * y, plus: Callable[[Column, Column], Column] = lambda x, y: x + y,
) -> Column:
    """Products summed over pairs of contracted axes, for every batch: axes of the result are those of the batch, the rest of ``a``, the rest of ``b``.

    Elements may be of any kind, such as structs of two parts, with ``zero``, ``times`` and ``plus`` of theirs.
    """
    for (x, y), shapes in ((contract, (a_shape, b_shape)), (batch, (a_shape, b_shape))):
        if len(x) != len(y) or any(shapes[0][i] != shapes[1][j] for i, j in zip(x, y)):
            raise ValueError("paired axes have one size")
    outer = list(zip(places(a_shape, batch[0]), places(b_shape, batch[1])))
    rows, columns = (places(s, _rest(s, [*batch[i], *contract[i]])) for i, s in enumerate((a_shape, b_shape)))
    terms = [places(s, c) for s, c in zip((a_shape, b_shape), contract)]
    begins = [(x + r, y + c) for x, y in outer for r in rows for c in columns]
    start = F.lit(0.0) if zero is None else zero

    def written(x: Column, y: Column) -> Column:
        out = []
        for r, c in begins:
            acc = start
            for i, j in zip(*terms):
                acc = plus(acc, times(at(x, r + i), at(y, c + j)))
            out.append(acc)
        return F.array(*out)

    if len(terms[0]) <= WRITTEN_FOLD and 0 < len(begins) * len(terms[0]) <= WRITTEN:
        return bound(written, a, b)
    inner = [_numbers(t) for t in terms]
    starts = F.array(*[F.struct(F.lit(r).alias("x"), F.lit(c).alias("y")) for r, c in begins])
    along = lambda v, begin, ks: F.transform(ks, lambda k: F.get(v, begin + k))
    products = lambda x, y, o: F.zip_with(along(x, o["x"], inner[0]), along(y, o["y"], inner[1]), lambda p, r: times(p, r))
    return bound(lambda x, y: F.transform(starts, lambda o: F.aggregate(products(x, y, o), start, lambda acc, p: plus(acc, p))), a, b)


def _row(arrays: Sequence[Column], i: Column) -> Column:
    return at(arrays[0], i) if len(arrays) == 1 else F.struct(*(at(a, i).alias(f"f{n}") for n, a in enumerate(arrays)))


def fold_axes(arrays: Sequence[Column], shape: Shape, axes: Sequence[int], start: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Folds arrays of one shape over any axes, in row-major order; ``combine`` takes what is so far and an element, of several arrays a struct ``f0``, ``f1``, ..."""
    inner, outer = places(shape, axes), places(shape, _rest(shape, axes))
    if len(inner) <= WRITTEN_FOLD and len(inner) * len(outer) <= WRITTEN:
        return bound(lambda *vs: _folds([[o + i for i in inner] for o in outer], start, combine, lambda i: _row(vs, i)), *arrays)
    return bound(lambda *vs: F.transform(_numbers(outer), lambda o: F.aggregate(_numbers(inner), start, lambda acc, i: combine(acc, _row(vs, o + i)))), *arrays)


def window_shape(shape: Shape, size: Shape, stride: Shape, dilation: Shape, padding: Sequence[tuple[int, int]], base_dilation: Shape) -> list[int]:
    """How many windows there are along each axis."""
    out = []
    for n, k, s, d, (low, high), b in zip(shape, size, stride, dilation, padding, base_dilation):
        room = (n - 1) * b + 1 + low + high - ((k - 1) * d + 1) if n else -1
        out.append(room // s + 1 if room >= 0 else 0)
    return out


def fold_windows(
    arrays: Sequence[Column], shape: Shape, size: Shape, start: Column, combine: Callable[[Column, Column], Column], stride: Shape | None = None,
    dilation: Shape | None = None, padding: Sequence[tuple[int, int]] | None = None, base_dilation: Shape | None = None,
) -> Column:
    """Folds windows over every axis, with steps and holes of its own; places outside, or between elements that ``base_dilation`` moves apart, are skipped."""
    n = len(shape)
    stride, dilation, base_dilation = (list(x or [1] * n) for x in (stride, dilation, base_dilation))
    padding = list(padding or [(0, 0)] * n)
    per_axis = []  # for each axis, for each window, the elements it meets
    for a, windows in enumerate(window_shape(shape, size, stride, dilation, padding, base_dilation)):
        met = [[w * stride[a] + i * dilation[a] - padding[a][0] for i in range(size[a])] for w in range(windows)]
        per_axis.append([[p // base_dilation[a] for p in ps if p % base_dilation[a] == 0 and 0 <= p // base_dilation[a] < shape[a]] for ps in met])
    sets, own = [[0]], strides(shape)
    for a in range(n):
        sets = [[base + i * own[a] for base in held for i in ps] for held in sets for ps in per_axis[a]]
    if not sets:
        return F.slice(F.array(start), 1, 0)
    return bound(lambda *vs: _folds(sets, start, combine, lambda i: _row(vs, i)), *arrays)


def _starts(indices: Column, index_shape: Shape, vector_axis: int, n: int) -> tuple[list[int], int]:
    """Where each start's coordinates begin in ``indices``, and how far apart they are; without an axis for them each is a single number."""
    shape = [*index_shape, 1] if vector_axis == len(index_shape) else list(index_shape)
    if shape[vector_axis] != n:
        raise ValueError("an index has a coordinate for each of the axes it maps to")
    return places(shape, _rest(shape, [vector_axis])), strides(shape)[vector_axis]


def gather_nd(
    a: Column, shape: Shape, indices: Column, index_shape: Shape, slice_sizes: Shape, offset_dims: Sequence[int], collapsed: Sequence[int], start_map: Sequence[int], vector_axis: int,
) -> Column:
    """Slices of ``slice_sizes`` at starts that ``indices`` hold along ``vector_axis``, for the axes ``start_map``.

    Starts are moved so that slices lie inside.  Axes of a slice other than the
    ``collapsed`` ones, of size 1, become ``offset_dims`` of the result, those of
    the indices the others.
    """
    if any(slice_sizes[c] != 1 for c in collapsed) or any(s > n for s, n in zip(slice_sizes, shape)):
        raise ValueError("a slice lies in the array, with size 1 along collapsed axes")
    begins, apart = _starts(indices, index_shape, vector_axis, len(start_map))
    window = _rest(shape, collapsed)
    own = strides(shape)
    batch_shape = [n for i, n in enumerate(index_shape) if i != vector_axis]
    inside = places([slice_sizes[w] for w in window], range(len(window)), [own[w] for w in window])
    # In the order of indices, then of places in the slice; then axes go where the result has them.
    base = lambda held, b: sum((F.least(F.greatest(F.get(held, b + F.lit(k * apart)), F.lit(0)), F.lit(shape[d] - slice_sizes[d])) * own[d] for k, d in enumerate(start_map)), F.lit(0))
    made = batch_shape + [slice_sizes[w] for w in window]
    batch_axes = [d for d in range(len(made)) if d not in offset_dims]
    order = [0] * len(made)
    for source, axis in enumerate([*batch_axes, *offset_dims]):
        order[axis] = source
    if 0 < len(begins) * len(inside) <= WRITTEN:
        lying = [(b, i) for b in begins for i in inside]
        return bound(lambda v, held: F.array(*[at(v, (base(held, F.lit(lying[p][0])) + F.lit(lying[p][1])).cast("int")) for p in places(made, order)]), a, indices)
    bases = bound(lambda held: F.transform(_numbers(begins), lambda b: base(held, b)), indices)
    found = bound(lambda v: F.flatten(F.transform(bases, lambda s: F.transform(_numbers(inside), lambda i: at(v, (s + i).cast("int"))))), a)
    return permute(found, made, order)


def scatter_nd(
    a: Column, shape: Shape, indices: Column, index_shape: Shape, updates: Column, update_shape: Shape, combine: Callable[[Column, Column], Column],
    window_dims: Sequence[int], inserted: Sequence[int], index_map: Sequence[int], vector_axis: int,
) -> Column:
    """Combines windows of ``updates`` into the array at starts that ``indices`` hold, one update after another.

    ``window_dims`` of the updates lie along the axes that aren't ``inserted``,
    the others number the indices.  Updates that fall outside are dropped.
    """
    begins, apart = _starts(indices, index_shape, vector_axis, len(index_map))
    batch = _rest(update_shape, window_dims)
    along = _rest(shape, inserted)
    own, coordinates = strides(shape), []
    for axis in range(len(shape)):
        step = [0] * len(update_shape)
        if axis in along:
            step[window_dims[along.index(axis)]] = 1
        coordinates.append(places(update_shape, range(len(update_shape)), step))
    numbered = [0] * len(update_shape)
    for s, d in zip(strides([update_shape[d] for d in batch]), batch):
        numbered[d] = s
    which = places(update_shape, range(len(update_shape)), numbered)

    def placed(held: Column, r: Column | dict[str, Column]) -> Column:
        full = [r[f"c{d}"] + (F.get(held, r["b"] + F.lit(index_map.index(d) * apart)) if d in index_map else F.lit(0)) for d in range(len(shape))]
        inside = F.lit(True)
        for x, n in zip(full, shape):
            inside = inside & (x >= 0) & (x < n)
        return F.when(inside, sum((x * s for x, s in zip(full, own)), F.lit(0)))

    def written(v: Column, held: Column, us: Column) -> Column:
        found = [placed(held, {"b": F.lit(begins[w]), **{f"c{d}": F.lit(c[n]) for d, c in enumerate(coordinates)}}) for n, w in enumerate(which)]
        out = []
        for i in places(shape, range(len(shape))):
            x = at(v, i)
            for n, where in enumerate(found):
                x = F.when(where == i, combine(x, at(us, n))).otherwise(x)
            out.append(x)
        return F.when(v.isNotNull(), F.array(*out))

    size = len(places(shape, range(len(shape))))
    if len(which) <= WRITTEN_FOLD and 0 < size * len(which) <= WRITTEN:
        return bound(written, a, indices, updates)
    rows = F.array(*[F.struct(F.lit(n).alias("u"), F.lit(begins[w]).alias("b"), *(F.lit(c[n]).alias(f"c{d}") for d, c in enumerate(coordinates))) for n, w in enumerate(which)])
    hits = bound(lambda held: F.transform(rows, lambda r: F.struct(placed(held, r).alias("at"), r["u"].alias("u"))), indices)
    return bound(lambda met, us: F.transform(a, lambda x, i: F.aggregate(F.filter(met, lambda h: h["at"] == i), x, lambda acc, h: combine(acc, F.get(us, h["u"])))), hits, updates)
