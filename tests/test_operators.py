import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.functions import scalar
from meshlark.functions.bspline import bspline, horner
from meshlark.functions.complex import Complex
from meshlark.operators.scatter import expand_support, gather_from_mesh, scatter_over_support, scatter_to_mesh
from meshlark.operators.spectral import dft, inverse_dft, spectral_map
from meshlark.streaming.incremental import streaming_coordination, streaming_density


@pytest.mark.parametrize("order", [2, 3, 4, 5, 6])
def test_spline_weights_sum_to_one_and_factors_are_positive(spark, order):
    spline = bspline(order)
    t = spark.range(17).select((F.col("id") / 16.0).alias("t"))
    for r in t.select(sum(spline.weights(F.col("t")), F.lit(0.0)).alias("w"), sum(spline.weights(F.col("t"), 1), F.lit(0.0)).alias("d")).collect():
        assert r.w == pytest.approx(1, abs=1e-12) and r.d == pytest.approx(0, abs=1e-12)
    assert min(spline.fourier_factor(8)) > 0 and len(spline.offsets) == order


def test_bad_splines():
    with pytest.raises(ValueError):
        bspline(1)
    with pytest.raises(ValueError):
        bspline(6).fourier_factor(5)


def grid_frame(spark, a):
    rows = [(int(b), *map(int, i), float(a[(b, *i)].real), float(a[(b, *i)].imag)) for b in range(a.shape[0]) for i in np.ndindex(a.shape[1:])]
    return spark.createDataFrame(rows, "batch int, ix int, iy int, iz int, v_re double, v_im double").coalesce(2)


def dense(df, shape):
    out = np.zeros(shape, complex)
    for r in df.collect():
        out[r.batch, r.ix, r.iy, r.iz] = complex(r.v_re, r.v_im)
    return out


@pytest.mark.parametrize("shape,sign", [((3, 4, 5), -1), ((4, 3, 6), 1)])
def test_transforms_match_numpy_and_return(spark, shape, sign):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2, *shape)) + 1j * rng.normal(size=(2, *shape))
    n = math.prod(shape)
    there = dft(grid_frame(spark, a), shape, ["v"], sign, ("batch",))
    want = np.fft.fftn(a, axes=(1, 2, 3)) if sign < 0 else np.fft.ifftn(a, axes=(1, 2, 3)) * n
    assert dense(there, a.shape) == pytest.approx(want, abs=1e-10)
    assert dense(inverse_dft(there, shape, ["v"], sign, ("batch",)), a.shape) == pytest.approx(a, abs=1e-12)
    half = dft(grid_frame(spark, a.real + 0j), shape, ["v"], sign, ("batch",), half=True)
    want = np.fft.rfftn(a.real, axes=(1, 2, 3))
    assert dense(half, want.shape) == pytest.approx(want if sign < 0 else want.conj(), abs=1e-10)
    assert dense(inverse_dft(half, shape, ["v"], sign, ("batch",), half=True), a.shape) == pytest.approx(a.real, abs=1e-12)


def test_spectral_map_sums_and_filters(spark):
    shape = (4, 6, 4)
    a = np.random.default_rng(2).normal(size=(2, *shape)) + 0j
    fn = lambda i, v: ({"v": v["v"].scale(1.0 / (1 + i[0] * i[0] + i[2] * i[2]))}, {"p": v["v"] * v["v"].conjugate()})
    back, aux = spectral_map(fn, grid_frame(spark, a), shape, ["v"], keys=("batch",), is_hermitian=True, aux_keys=("batch",))
    kx, kz = np.fft.fftfreq(4, 1 / 4)[:, None, None], np.fft.rfftfreq(4, 1 / 4)[None, None, :]
    want = np.fft.irfftn(np.fft.rfftn(a.real, axes=(1, 2, 3)) / (1 + kx**2 + kz**2), s=shape, axes=(1, 2, 3))
    assert dense(back, a.shape) == pytest.approx(want, abs=1e-12)
    power = {r.batch: r.p_re for r in aux.collect()}
    assert [power[b] for b in (0, 1)] == pytest.approx([math.prod(shape) * (a[b].real ** 2).sum() for b in (0, 1)])
    with pytest.raises(ValueError):
        dft(grid_frame(spark, a), shape, ["v"], sign=2)


def points(spark, n=40):
    rng = random.Random(3)
    return spark.createDataFrame([(i, rng.randint(-20, 20), rng.randint(-20, 20), rng.randint(-20, 20), rng.random()) for i in range(n)], "p int, cx int, cy int, cz int, c double")


def test_scatter_keeps_mass_and_gather_is_its_transpose(spark):
    df, shape, cross = points(spark), (5, 3, 4), [(0, 0, 0), (1, 0, 0), (0, -1, 0), (0, 0, 2)]
    weight = lambda s: s.index[0] + 1.0
    grid = scatter_to_mesh(df, cross, lambda s: {"value": weight(s) * F.col("c")}, shape)
    cells = {(r.ix, r.iy, r.iz): r.value for r in grid.collect()}
    want = {}
    for r in df.collect():
        for (i, _, _), o in expand_support(cross):
            key = tuple((c + d) % n for c, d, n in zip((r.cx, r.cy, r.cz), o, shape))
            want[key] = want.get(key, 0) + (i + 1) * r.c
    assert cells == pytest.approx(want)
    out = gather_from_mesh(df, cross, lambda s: {"g": weight(s) * s.grid["phi"]}, shape, grids={"phi": (grid, ())}, point_key=("p", "c"))
    assert sum(r.c * r.g for r in out.collect()) == pytest.approx(sum(v * v for v in cells.values()))


def test_scatter_validation(spark):
    df = points(spark, 1)
    with pytest.raises(ValueError):
        scatter_to_mesh(df, [(0, 0)], lambda s: {}, (2, 2, 2))
    with pytest.raises(ValueError):
        scatter_to_mesh(df, (0, 1), lambda s: {}, (2, 2))
    with pytest.raises(ValueError):
        scatter_over_support(df, (0,), lambda s: {}, (2, 2, 2))
    with pytest.raises(ValueError):
        gather_from_mesh(df, (0,), lambda s: {}, (2, 2, 2), grids={"g": (df, ())})


def test_ieee_corners(spark):
    x = F.col("x")
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, 0.0), (1, -1.0), (2, inf), (3, nan), (4, 2.5)], "i int, x double")
    out = {r.i: r for r in df.select("i", scalar.divide(F.lit(1.0), x).alias("d"), scalar.log(x).alias("l"), scalar.sign(x).alias("s"), scalar.maximum(x, F.lit(1.0)).alias("m"), scalar.compare("NE", x, x).alias("ne"), scalar.is_finite(x).alias("f"), scalar.round_even(x).alias("e"), scalar.round_away(x).alias("a")).collect()}
    assert out[0].d == inf and out[2].d == 0 and math.isnan(out[3].d)
    assert out[0].l == -inf and math.isnan(out[1].l) and out[2].l == inf
    assert [out[i].s for i in range(5)] == [0, -1, 1, 0, 1]
    assert out[3].m == 1 and out[3].ne and not out[0].ne and [out[i].f for i in range(5)] == [True, True, False, False, True]
    assert out[4].e == 2 and out[4].a == 3
    z = spark.range(1).select((Complex(F.lit(1.0), F.lit(2.0)) / Complex(F.lit(0.0), F.lit(1.0))).struct().alias("z")).first().z
    assert (z.re, z.im) == (2, -1)
    assert spark.range(1).select(horner((1.0, 0.0, 2.0), F.lit(3.0)).alias("h")).first().h == 19


def test_stream_of_edges_sums_up(spark, tmp_path):
    atoms = spark.createDataFrame([(0, 0.7, 0.0, 0.0, 0.0), (1, 0.8, 1.1, 0.2, 0.0)], "atom_id bigint, rcov double, x double, y double, z double")
    schema = "src bigint, dst bigint, sx int, sy int, sz int"
    for k in range(3):
        spark.createDataFrame([(0, 1, 0, 0, 0), (1, 0, k, 0, 0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/edges")
    cell = ((5.0, 0, 0), (0, 5.0, 0), (0, 0, 5.0))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/edges")
    run = streaming_coordination(atoms, stream, cell, 6.0).writeStream.format("memory").queryName("cn").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    want = {r.src: r.cn for r in streaming_coordination(atoms, spark.read.parquet(f"{tmp_path}/edges"), cell, 6.0).collect()}
    assert {r.src: r.cn for r in spark.table("cn").collect()} == pytest.approx(want)


def test_stream_of_points_sums_up(spark, tmp_path):
    df = points(spark)
    for k in range(3):
        df.where(F.col("p") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/points")
    kernel = lambda s: {"value": (s.index[0] + 1.0) * F.col("c")}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/points")
    run = streaming_density(stream, (0, 1), kernel, (5, 3, 4)).writeStream.format("memory").queryName("density").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    cells = lambda out: {(r.ix, r.iy, r.iz): r.value for r in out.collect()}
    assert cells(spark.table("density")) == pytest.approx(cells(scatter_to_mesh(df, (0, 1), kernel, (5, 3, 4))))


def test_signs_may_differ_by_name(spark):
    shape = (3, 4, 5)
    rng = np.random.default_rng(4)
    a, b = (rng.normal(size=(2, *shape)) + 1j * rng.normal(size=(2, *shape)) for _ in range(2))
    table = grid_frame(spark, a).join(grid_frame(spark, b).withColumnsRenamed({"v_re": "w_re", "v_im": "w_im"}), ["batch", "ix", "iy", "iz"])
    fn = lambda i, x: ({"v": x["v"] * x["w"], "w": x["v"] + x["w"]}, {"s": x["v"] * x["w"]})
    back, sums = spectral_map(fn, table, shape, ["v", "w"], sign={"v": -1, "w": 1}, keys=("batch",), aux_keys=("batch",))
    over = lambda f, x: f(x, axes=(1, 2, 3))
    fa, fb = over(np.fft.fftn, a), over(np.fft.ifftn, b) * math.prod(shape)
    assert dense(back, a.shape) == pytest.approx(over(np.fft.ifftn, fa * fb), abs=1e-8)
    w = back.select("batch", "ix", "iy", "iz", F.col("w_re").alias("v_re"), F.col("w_im").alias("v_im"))
    assert dense(w, a.shape) == pytest.approx(over(np.fft.fftn, fa + fb) / math.prod(shape), abs=1e-9)
    got = {r.batch: complex(r.s_re, r.s_im) for r in sums.collect()}
    assert [got[0], got[1]] == pytest.approx(list((fa * fb).sum(axis=(1, 2, 3))))
