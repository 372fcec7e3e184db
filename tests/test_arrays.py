"""Operations on flat arrays of several axes against numpy, and 64-bit integers that wrap."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.functions import arrays, scalar
from meshlark.functions.complex import Complex


def run(spark, make, **inputs):
    """What ``make(**columns)`` gives for flat arrays."""
    row = {k: np.asarray(v).ravel().tolist() for k, v in inputs.items()}
    kinds = ", ".join(f"{k} array<{'int' if np.asarray(v).dtype.kind == 'i' and k == 'i' else 'double'}>" for k, v in inputs.items())
    df = spark.createDataFrame([tuple(row.values())], kinds)
    return df.select(make(**{k: F.col(k) for k in inputs}).alias("out")).first().out


def real(*shape, seed=1):
    return np.random.default_rng(seed).integers(-9, 9, shape).astype(float)


def test_axes_move_and_spread(spark):
    a = real(2, 3, 4)
    assert run(spark, lambda a: arrays.permute(a, (2, 3, 4), (2, 0, 1)), a=a) == a.transpose(2, 0, 1).ravel().tolist()
    b = real(3, 1)
    want = np.broadcast_to(b.reshape(1, 3, 1), (2, 3, 4))
    assert run(spark, lambda a: arrays.broadcast_in_dim(a, (3, 1), (2, 3, 4), (1, 2)), a=b) == want.ravel().tolist()
    with pytest.raises(ValueError):
        arrays.broadcast_in_dim(F.col("a"), (3, 2), (2, 3, 4), (1, 2))


@pytest.mark.parametrize("spec,a_shape,b_shape,contract,batch", [
    ("ij,jk->ik", (2, 3), (3, 4), ((1,), (0,)), ((), ())),
    ("bij,kbj->bik", (2, 3, 4), (5, 2, 4), ((2,), (2,)), ((0,), (1,))),
    ("ijk,kjl->il", (2, 3, 4), (4, 3, 2), ((1, 2), (1, 0)), ((), ())),
    ("i,j->ij", (3,), (2,), ((), ()), ((), ())),
    ("abij,ijab->ab", (2, 2, 3, 2), (3, 2, 2, 2), ((2, 3), (0, 1)), ((0, 1), (2, 3))),
])
def test_contractions(spark, spec, a_shape, b_shape, contract, batch):
    a, b = real(*a_shape), real(*b_shape, seed=2)
    got = run(spark, lambda a, b: arrays.dot_general(a, b, a_shape, b_shape, contract, batch), a=a, b=b)
    assert got == np.einsum(spec, a, b).ravel().tolist()


def test_complex_contraction(spark):
    a, b = real(2, 3) + 1j * real(2, 3, seed=3), real(3, 2, seed=4) + 1j * real(3, 2, seed=5)
    pack = lambda re, im: F.arrays_zip(re.alias("re"), im.alias("im"))
    of = lambda x: Complex(x["re"], x["im"])
    zero = Complex(F.lit(0.0), F.lit(0.0)).struct()
    make = lambda ar, ai, br, bi: arrays.dot_general(pack(ar, ai), pack(br, bi), (2, 3), (3, 2), ((1,), (0,)), zero=zero, times=lambda x, y: (of(x) * of(y)).struct(), plus=lambda x, y: (of(x) + of(y)).struct())
    got = run(spark, make, ar=a.real, ai=a.imag, br=b.real, bi=b.imag)
    assert [complex(r.re, r.im) for r in got] == (a @ b).ravel().tolist()


@pytest.mark.parametrize("axes", [(0,), (1,), (0, 2), (2, 1), (0, 1, 2)])
def test_folds_over_any_axes(spark, axes):
    a, b = real(2, 3, 4), real(2, 3, 4, seed=6)
    assert run(spark, lambda a: arrays.fold_axes([a], (2, 3, 4), axes, F.lit(-1e9), F.greatest), a=a) == a.max(axis=axes).ravel().tolist()
    two = lambda acc, r: F.struct((acc["s"] + r["f0"]).alias("s"), (acc["p"] + r["f0"] * r["f1"]).alias("p"))
    got = run(spark, lambda a, b: arrays.fold_axes([a, b], (2, 3, 4), axes, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("p")), two), a=a, b=b)
    assert [(r.s, r.p) for r in got] == list(zip(a.sum(axis=axes).ravel(), (a * b).sum(axis=axes).ravel()))


@pytest.mark.parametrize("size,stride,dilation,padding,base", [
    ((2, 2), (1, 1), (1, 1), ((0, 0), (0, 0)), (1, 1)), ((2, 3), (2, 1), (1, 2), ((1, 0), (2, 1)), (1, 1)), ((3, 1), (1, 2), (2, 1), ((2, 2), (0, 0)), (1, 3)),
    ((1, 2), (1, 1), (1, 1), ((0, 0), (-1, -1)), (2, 1)), ((9, 9), (1, 1), (1, 1), ((0, 0), (0, 0)), (1, 1)),
])
def test_windows(spark, size, stride, dilation, padding, base):
    shape = (4, 5)
    a = real(*shape)
    wide = np.full([(n - 1) * b + 1 for n, b in zip(shape, base)], np.nan)
    wide[:: base[0], :: base[1]] = a
    at = lambda i, j: wide[i, j] if 0 <= i < wide.shape[0] and 0 <= j < wide.shape[1] else np.nan
    counts = [max(0, (w + lo + hi - ((k - 1) * d + 1)) // s + 1) if w + lo + hi >= (k - 1) * d + 1 else 0 for w, (lo, hi), k, d, s in zip(wide.shape, padding, size, dilation, stride)]
    want = [np.nansum([at(i * stride[0] + k * dilation[0] - padding[0][0], j * stride[1] + l * dilation[1] - padding[1][0]) for k in range(size[0]) for l in range(size[1])]) for i in range(counts[0]) for j in range(counts[1])]
    got = run(spark, lambda a: arrays.fold_windows([a], shape, size, F.lit(0.0), lambda x, y: x + y, stride, dilation, padding, base), a=a)
    assert got == want and arrays.window_shape(shape, size, stride, dilation, padding, base) == counts


def gathered(a, indices, sizes, offset_dims, collapsed, start_map, vector_axis):
    """The definition, element by element."""
    starts = np.moveaxis(indices if vector_axis < indices.ndim else indices[..., None], vector_axis, -1)
    window = [d for d in range(a.ndim) if d not in collapsed]
    batch, inner = starts.shape[:-1], [sizes[w] for w in window]
    rank = len(batch) + len(inner)
    batch_dims = [d for d in range(rank) if d not in offset_dims]
    out = np.zeros([dict(zip([*batch_dims, *offset_dims], [*batch, *inner]))[d] for d in range(rank)])
    for place in np.ndindex(*out.shape):
        s = starts[tuple(place[d] for d in batch_dims)]
        full = [0] * a.ndim
        for k, d in enumerate(start_map):
            full[d] = min(max(s[k], 0), a.shape[d] - sizes[d])
        for d, o in zip(window, offset_dims):
            full[d] += place[o]
        out[place] = a[tuple(full)]
    return out


@pytest.mark.parametrize("index_shape,sizes,offset_dims,collapsed,start_map,vector_axis", [
    ((3, 2), (1, 1, 4), (1,), (0, 1), (0, 1), 1), ((2, 3), (2, 1, 2), (0, 2), (1,), (2, 0), 0), ((2, 2), (2, 3, 1), (0, 1, 3), (), (2,), 2), ((1,), (1, 2, 4), (0, 1), (0,), (1,), 0),
])
def test_gather(spark, index_shape, sizes, offset_dims, collapsed, start_map, vector_axis):
    a = real(2, 3, 4)
    i = np.random.default_rng(8).integers(-3, 6, index_shape)
    got = run(spark, lambda a, i: arrays.gather_nd(a, (2, 3, 4), i, index_shape, sizes, offset_dims, collapsed, start_map, vector_axis), a=a, i=i)
    assert got == gathered(a, i, sizes, offset_dims, collapsed, start_map, vector_axis).ravel().tolist()


@pytest.mark.parametrize("index_shape,update_shape,window_dims,inserted,index_map,vector_axis", [
    ((3, 2), (3, 4), (1,), (0, 1), (0, 1), 1), ((2, 3), (2, 3, 2), (0, 2), (1,), (2, 0), 0), ((2, 2), (2, 3, 2, 1, 2), (0, 1, 3), (), (2,), 2), ((1,), (2, 4), (0, 1), (0,), (1,), 0),
])
def test_scatter(spark, index_shape, update_shape, window_dims, inserted, index_map, vector_axis):
    a, u = real(2, 3, 4), real(*update_shape, seed=9)
    i = np.random.default_rng(10).integers(-1, 4, index_shape)
    want = a.copy()
    starts = np.moveaxis(i if vector_axis < i.ndim else i[..., None], vector_axis, -1)
    batch_dims, along = [d for d in range(u.ndim) if d not in window_dims], [d for d in range(3) if d not in inserted]
    for place in np.ndindex(*update_shape):
        s, full = starts[tuple(place[d] for d in batch_dims)], [0, 0, 0]
        for k, d in enumerate(index_map):
            full[d] = s[k]
        for d, w in zip(along, window_dims):
            full[d] += place[w]
        if all(0 <= x < n for x, n in zip(full, a.shape)):
            want[tuple(full)] = 2 * want[tuple(full)] + u[place]
    got = run(spark, lambda a, i, u: arrays.scatter_nd(a, (2, 3, 4), i, index_shape, u, update_shape, lambda x, y: 2 * x + y, window_dims, inserted, index_map, vector_axis), a=a, i=i, u=u)
    assert got == want.ravel().tolist()


def test_longs_wrap(spark):
    rng = random.Random(11)
    edge = [0, 1, -1, 2**63 - 1, -(2**63), 2**32, 2**32 - 1, -(2**32), 3037000500]
    pairs = list(itertools.product(edge, edge)) + [(rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63) for _ in range(300)]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    for r in df.select("a", "b", scalar.wrapping_add(a, b).alias("s"), scalar.wrapping_subtract(a, b).alias("d"), scalar.wrapping_multiply(a, b).alias("p")).collect():
        assert (r.s, r.d, r.p) == (wrap(r.a + r.b), wrap(r.a - r.b), wrap(r.a * r.b))


def test_complex_differs(spark):
    z = lambda re, im: Complex(F.lit(re), F.lit(im))
    nan = float("nan")
    row = spark.range(1).select(z(1.0, 2.0).differs(z(1.0, 2.0)), z(1.0, 2.0).differs(z(1.0, 3.0)), z(nan, 2.0).differs(z(nan, 2.0)), z(1.0, 2.0).equals(z(1.0, 2.0)), z(nan, 2.0).equals(z(nan, 2.0))).first()
    assert list(row) == [False, True, True, True, False]


MANY = [float(i) for i in range(24)]


@pytest.mark.parametrize("written", [0, 256])
@pytest.mark.parametrize("make,want", [
    (lambda a: arrays.permute(a, (24,), (0,)), MANY), (lambda a: arrays.broadcast_in_dim(a, (24,), (24,), (0,)), MANY), (lambda a: arrays.take(a, range(24)), MANY), (lambda a: arrays.pad(a, 24, F.lit(0.0)), MANY),
    (lambda a: arrays.gather(a, arrays.iota(24), 24), MANY), (lambda a: arrays.gather_nd(a, (24,), F.array(F.lit(0)), (1,), (24,), (0,), (), (0,), 0), MANY),
    (lambda a: arrays.fold_axes([a], (24, 1), (1,), F.lit(0.0), lambda x, y: x + y), MANY), (lambda a: arrays.fold_windows([a], (24,), (1,), F.lit(0.0), lambda x, y: x + y), MANY),
    (lambda a: arrays.dot_general(a, F.array(F.lit(1.0)), (24, 1), (1, 1), ((1,), (0,))), MANY), (lambda a: arrays.reduce_window(a, 24, 1, F.lit(0.0), lambda x, y: x + y), MANY),
    (lambda a: arrays.scatter_nd(F.array_repeat(F.lit(0.0), 24), (24,), F.array(F.lit(0)), (1,), a, (24,), lambda x, y: y, (0,), (), (0,), 0), MANY),
])
def test_an_operand_is_computed_once(spark, monkeypatch, make, want, written):
    """A shuffled operand would come in another order with every time it is computed."""
    monkeypatch.setattr(arrays, "WRITTEN", written)
    assert sorted(run(spark, lambda a: make(F.shuffle(a)), a=MANY)) == want


@pytest.mark.parametrize("make", [
    lambda a: arrays.dot_general(a, a, (2, 3), (3, 2), ((1,), (0,))), lambda a: arrays.fold_axes([a], (2, 3), (0,), F.lit(-1e9), lambda x, y: F.greatest(x, y)),
    lambda a: arrays.fold_windows([a], (2, 3), (2, 2), F.lit(0.0), lambda x, y: x + y, padding=((0, 1), (1, 1))), lambda a: arrays.permute(a, (2, 3), (1, 0)),
    lambda a: arrays.gather_nd(a, (2, 3), F.array(F.lit(7), F.lit(-1), F.lit(1), F.lit(1)), (2, 2), (1, 2), (0,), (0,), (0, 1), 1),
    lambda a: arrays.scatter_nd(a, (2, 3), F.array(F.lit(1), F.lit(2)), (2,), F.array(F.lit(5.0), F.lit(6.0)), (1, 2), lambda x, y: 2 * x + y, (1,), (0,), (0, 1), 0),
])
def test_written_out_and_in_lambdas(spark, monkeypatch, make):
    a = real(2, 3)
    out = run(spark, make, a=a)
    empty = spark.createDataFrame([(None,)], "a array<double>").select(make(F.col("a")).alias("out"))
    null = empty.first().out
    monkeypatch.setattr(arrays, "WRITTEN", 0)
    assert out == run(spark, make, a=a)
    assert null == spark.createDataFrame([(None,)], "a array<double>").select(make(F.col("a")).alias("out")).first().out
