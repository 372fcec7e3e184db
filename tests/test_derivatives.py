import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.functions import graph
from meshlark.functions.complex import Complex
from meshlark.functions.graph import Node
from meshlark.operators import adjoint
from meshlark.operators.relations import Relation
from meshlark.operators.scatter import expand_support, scatter_over_support
from meshlark.operators.spectral import dft, spectral_map

from .test_operators import dense, grid_frame

SMOOTH = {
    "arithmetic": lambda x, y: (x + 2) * y - x / (y + 3) + (1 - x) * 2 - (-y),
    "powers": lambda x, y: x**3 + (x + 2) ** y + 2**y,
    "exponentials": lambda x, y: graph.exp(x) + graph.expm1(y) + graph.log(x + 2) + graph.log1p(y),
    "roots": lambda x, y: graph.sqrt(x + 2) * graph.rsqrt(y + 1) + graph.square(x * y),
    "circular": lambda x, y: graph.sin(x) * graph.cos(y) + graph.tan(x * 0.3) + graph.atan(x + y),
    "hyperbolic": lambda x, y: graph.tanh(x) + graph.sinh(y) * graph.cosh(x) + graph.asinh(x) + graph.acosh(y + 2) + graph.atanh(x * 0.3),
    "inverse": lambda x, y: graph.asin(x * 0.3) + graph.acos(y * 0.3),
    "bounded": lambda x, y: graph.logistic(x) + graph.erf(y) * graph.erfc(x),
    "choices": lambda x, y: graph.maximum(x, y) * graph.minimum(x, y * 2) + abs(x) + graph.clamp(x, -0.5, 0.7) * y,
}


@pytest.mark.parametrize("name", SMOOTH)
def test_both_ways_follow_differences(spark, name):
    """Tangents and cotangents equal central differences, and so do second derivatives."""
    f, h = SMOOTH[name], 1e-5
    rng = random.Random(name)
    rows = [(rng.uniform(-1, 1.4), rng.uniform(0.1, 1)) for _ in range(20)]
    df = spark.createDataFrame(rows, "x double, y double")
    x, y = graph.leaf(F.col("x")), graph.leaf(F.col("y"))
    out = f(x, y)
    tangent = graph.forward({"f": out}, {x: F.lit(1.0), y: F.lit(-2.0)})["f"]
    back = graph.backward([(out, F.lit(3.0))], {"x": x, "y": y})
    second = graph.backward([(back["x"], F.lit(1.0))], {"x": x}).get("x", Node.of(0))
    at = lambda dx, dy: f(graph.leaf(F.col("x") + dx), graph.leaf(F.col("y") + dy)).column
    got = df.select(
        tangent.column.alias("t"), back["x"].column.alias("bx"), back["y"].column.alias("by"), second.column.alias("xx"), at(0, 0).alias("v"),
        *(at(dx * h, dy * h).alias(n) for n, dx, dy in (("e", 1, 0), ("w", -1, 0), ("n", 0, 1), ("s", 0, -1))),
    )
    for r in got.collect():
        fx, fy = (r.e - r.w) / (2 * h), (r.n - r.s) / (2 * h)
        assert r.t == pytest.approx(fx - 2 * fy, abs=2e-6, rel=2e-6)
        assert (r.bx, r.by) == pytest.approx((3 * fx, 3 * fy), abs=2e-6, rel=2e-6)
        if name != "choices":
            assert r.xx == pytest.approx(3 * (r.e - 2 * r.v + r.w) / h**2, abs=2e-3, rel=2e-3)


def test_what_is_zero_is_left_out(spark):
    x, y = graph.leaf(F.col("x")), graph.leaf(F.col("y"))
    results = {"a": x * 2, "b": y + 1, "c": graph.floor(x), "d": Node.of(4.0)}
    assert set(graph.forward(results, {x: F.lit(1.0)})) == {"a"}
    assert set(graph.backward([(results["a"], F.lit(1.0)), (results["c"], F.lit(1.0))], {"x": x, "y": y})) == {"x"}
    picked = graph.select(F.col("x") > 0, x * x, y)
    df = spark.createDataFrame([(3.0, 5.0), (-3.0, 5.0)], "x double, y double")
    back = graph.backward([(picked, F.lit(1.0))], {"x": x, "y": y})
    assert [tuple(r) for r in df.select(back["x"].column, back["y"].column).collect()] == [(6.0, 0.0), (0.0, 1.0)]


SHAPE = (3, 4, 5)


def grids(rng, n):
    return [rng.normal(size=(2, *SHAPE)) + 1j * rng.normal(size=(2, *SHAPE)) for _ in range(n)]


def framed(spark, **arrays):
    """One table with a grid per name."""
    out = None
    for v, a in arrays.items():
        own = grid_frame(spark, a).withColumnsRenamed({"v_re": f"{v}_re", "v_im": f"{v}_im"})
        out = own if out is None else out.join(own, ["batch", "ix", "iy", "iz"])
    return out


def read(df, v, shape=(2, *SHAPE)):
    return dense(df.withColumnsRenamed({f"{v}_re": "v_re", f"{v}_im": "v_im"}), shape)


def frequencies():
    return np.meshgrid(*(np.fft.fftfreq(n, 1 / n) for n in SHAPE), indexing="ij")


def test_relations_by_frequency_batch_and_nothing(spark):
    rng = np.random.default_rng(5)
    (a,) = grids(rng, 1)
    by_cell = rng.normal(size=SHAPE)
    cells = spark.createDataFrame([(*map(int, i), float(by_cell[i])) for i in np.ndindex(SHAPE) if i != (0, 0, 1)], "ix int, iy int, iz int, w double")
    batches = spark.createDataFrame([(0, 2.0), (1, -3.0)], "batch int, g double")
    several = spark.createDataFrame([(0, 1.0), (0, 10.0), (1, 4.0)], "batch int, m double")
    one = spark.createDataFrame([(0.5,)], "s double")
    captured, many = Relation(batches, ["batch"]), Relation(several, ["batch"], many=True)

    def fn(i, v, aux):
        return {"u": v["v"].scale(aux["cell"]["w"] * captured["g"])}, {"t": v["v"].scale(aux["one"]["s"] * many["m"])}

    back, sums = spectral_map(fn, grid_frame(spark, a), SHAPE, ["v"], keys=("batch",), aux={"cell": Relation(cells, ("ix", "iy", "iz")), "one": Relation(one)}, aux_keys=("batch",))
    by_cell[0, 0, 1] = 0  # no row
    spectrum = np.fft.fftn(a, axes=(1, 2, 3))
    each = np.array([11.0, 4.0])[:, None, None, None]
    n = np.array([2.0, 1.0])[:, None, None, None]  # rows of the many, which grids are added over too
    want = np.fft.ifftn(spectrum * by_cell * np.array([2.0, -3.0])[:, None, None, None] * n, axes=(1, 2, 3))
    assert read(back, "u") == pytest.approx(want, abs=1e-10)
    got = {r.batch: complex(r.t_re, r.t_im) for r in sums.collect()}
    assert [got[0], got[1]] == pytest.approx(list((spectrum * 0.5 * each).sum(axis=(1, 2, 3))), abs=1e-9)
    with pytest.raises(ValueError):
        captured["g"]
    two = Relation(one.union(one))
    with pytest.raises(Exception, match="one row"):
        spectral_map(lambda i, v: (None, {"t": v["v"].scale(two["s"])}), grid_frame(spark, a), SHAPE, ["v"], keys=("batch",))[1].collect()


def test_batches_are_reduced_before_one_transform_back(spark):
    rng = np.random.default_rng(6)
    a, b = grids(rng, 2)
    shared = grid_frame(spark, b).where("batch = 0").drop("batch").withColumnsRenamed({"v_re": "k_re", "v_im": "k_im"})
    fn = lambda i, v: ({"u": v["v"] * v["k"]}, None)
    both = [(grid_frame(spark, a), ["v"], ["batch"]), (shared, ["k"], [])]
    back, _ = spectral_map(fn, both, SHAPE, grid_keys=())
    assert back.columns == ["ix", "iy", "iz", "u_re", "u_im"]
    want = np.fft.ifftn((np.fft.fftn(a, axes=(1, 2, 3)) * np.fft.fftn(b[0])).sum(axis=0))
    assert read(back.withColumn("batch", F.lit(0)), "u", (1, *SHAPE))[0] == pytest.approx(want, abs=1e-9)
    text = back._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 3 * 3  # two grids there, one back
    kept, _ = spectral_map(fn, both, SHAPE)
    assert "batch" in kept.columns
    real, _ = spectral_map(lambda i, v: (v, None), grid_frame(spark, a.real + 0j), SHAPE, ["v"], keys=("batch",), is_hermitian=True, real=True)
    assert real.columns == ["batch", "ix", "iy", "iz", "v_re"]


@pytest.mark.parametrize("shape", [(7, 1, 11), (2, 13, 8)])
def test_transforms_of_any_length(spark, shape):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(2, *shape)) + 0j
    sparse = grid_frame(spark, a).where("ix <> 0")
    a[:, 0] = 0
    assert dense(dft(sparse, shape, ["v"], keys=("batch",)), a.shape) == pytest.approx(np.fft.fftn(a, axes=(1, 2, 3)), abs=1e-9)


def mixed(i, v):
    """Linear, neither even nor real, and each output takes both inputs."""
    kx, ky, kz = i
    one = Complex(Node.of(F.exp(-kx * kx * 0.1)), Node.of(ky * 0.5))
    two = Complex(Node.of(1 + kz), Node.of(kx - 0.25))
    return {"p": v["a"] * one + v["b"] * two, "q": v["b"] * one - v["a"]}, None


@pytest.mark.parametrize("sign", [-1, 1])
def test_linear_transpose(spark, sign):
    rng = np.random.default_rng(8)
    a, b, p, q = grids(rng, 4)
    kx, ky, kz = frequencies()
    one, two = np.exp(-kx * kx * 0.1) + 0.5j * ky, 1 + kz + 1j * (kx - 0.25)
    there, back = (np.fft.fftn, np.fft.ifftn) if sign < 0 else (np.fft.ifftn, np.fft.fftn)
    over = lambda f, x: f(x, axes=(1, 2, 3))
    fa, fb = over(there, a), over(there, b)
    y = over(back, fa * one + fb * two), over(back, fb * one - fa)
    out = adjoint.linear_transpose(mixed, framed(spark, p=p, q=q), SHAPE, ["a", "b"], {"p": "p", "q": "q"}, sign, ("batch",))
    paired = (read(out, "a") * a).sum() + (read(out, "b") * b).sum()
    assert paired == pytest.approx((y[0] * p).sum() + (y[1] * q).sum(), rel=1e-9)
    wrong = adjoint.linear_transpose(mixed, framed(spark, p=p, q=q), SHAPE, ["a", "b"], {"p": "p", "q": "q"}, -sign, ("batch",))
    assert abs((read(wrong, "a") * a).sum() + (read(wrong, "b") * b).sum() - paired) > 1e-3


@pytest.mark.parametrize("hermitian", [False, True])
def test_spectral_derivatives_pair_up(spark, hermitian):
    """For a map that is not linear: cotangents times tangents are the same on both sides, and tangents are differences."""
    rng = np.random.default_rng(9)
    a, d, y = grids(rng, 3)
    if hermitian:
        a, d, y = (x.real + 0j for x in (a, d, y))

    def fn(i, v):
        c = v["a"]
        size = c.re * c.re + c.im * c.im
        damp = graph.exp(-size * 0.01)
        return {"u": Complex(c.re * damp, c.im * damp)}, {"s": Complex(graph.log1p(size), Node.of(0.0))}

    def value(x):
        f = np.fft.rfftn(x.real, axes=(1, 2, 3)) if hermitian else np.fft.fftn(x, axes=(1, 2, 3))
        damped = f * np.exp(-abs(f) ** 2 * 0.01)
        u = np.fft.irfftn(damped, s=SHAPE, axes=(1, 2, 3)) if hermitian else np.fft.ifftn(damped, axes=(1, 2, 3))
        w = np.full(f.shape[-1], 2.0 if hermitian else 1.0)
        w[0] = 1
        return u, (np.log1p(abs(f) ** 2) * w).sum(axis=(1, 2, 3))

    table = framed(spark, a=a, d=d, y=y)
    tangents, sums = adjoint.spectral_jvp(fn, table.drop("y_re", "y_im"), SHAPE, ["a"], {"a": "d"}, keys=("batch",), is_hermitian=hermitian, aux_keys=("batch",))
    h = 1e-6
    (u1, s1), (u0, s0) = value(a + h * d), value(a - h * d)
    moved = read(tangents, "u_tangent")
    assert moved == pytest.approx((u1 - u0) / (2 * h), abs=1e-6)
    by_batch = {r.batch: r.s_tangent_re for r in sums.collect()}
    assert [by_batch[0], by_batch[1]] == pytest.approx(list((s1 - s0) / (2 * h)), rel=1e-5)
    c = spark.createDataFrame([(0, 1.5, 0.0), (1, -0.5, 0.0)], "batch int, re double, im double")
    back = adjoint.spectral_vjp(fn, table.drop("d_re", "d_im"), SHAPE, ["a"], {"u": "y"}, {"s": Relation(c, ["batch"])}, keys=("batch",), is_hermitian=hermitian)
    left = (read(back, "a").conj() * d).sum().real
    assert left == pytest.approx((y.conj() * moved).sum().real + 1.5 * by_batch[0] - 0.5 * by_batch[1], rel=1e-8)


CROSS = [(0, 0, 0), (1, 0, 0), (0, -1, 0), (0, 0, 2)]


def scattered(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(-9, 9), rng.randint(-9, 9), rng.randint(-9, 9), *(rng.uniform(0.2, 1) for _ in range(4))) for i in range(30)]
    field = [(x, y, z, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1)) for x in range(5) for y in range(3) for z in range(4)]
    return spark.createDataFrame(rows, "p int, cx int, cy int, cz int, c double, e double, dc double, o double"), spark.createDataFrame(field, "ix int, iy int, iz int, value double, moved double, pulled double")


def test_both_outputs_come_from_one_stencil(spark):
    points, field = scattered(spark)
    rate = Relation(spark.createDataFrame([(i, float(i)) for i in range(30)], "p int, rate double"), ["p"])
    kernel = lambda s: ({"v": F.col("c") * (s.index[0] + 1), "n": F.lit(1)}, {"g": s.grid["f"] * F.col("e"), "r": rate["rate"]})
    more = {"grids": {"f": (field, ())}, "batch": (), "point_key": ("p",)}
    grid, out = scatter_over_support(points, CROSS, kernel, (5, 3, 4), **more)
    alone = scatter_over_support(points, CROSS, lambda s: (kernel(s)[0], None), (5, 3, 4), **more)[0], scatter_over_support(points, CROSS, lambda s: (None, kernel(s)[1]), (5, 3, 4), **more)[1]
    for got, want in zip((grid, out), alone):
        assert got.columns == want.columns
        assert [tuple(r) for r in got.orderBy(*got.columns[:3]).collect()] == [pytest.approx(tuple(r)) for r in want.orderBy(*want.columns[:3]).collect()]
    assert {r.p: r.r for r in out.collect()} == {i: 4.0 * i for i in range(30)}
    whole = scatter_over_support(points, CROSS, kernel, (5, 3, 4), grids={"f": (field, ())}, point_key=None)[1]
    assert set(whole.columns) == {*points.columns, "g", "r"} and whole.count() == 30


def test_scatter_derivatives_pair_up(spark):
    points, field = scattered(spark)

    def kernel(s, inputs, fields):
        c, f = inputs["c"], fields["f"]
        return {"v": graph.exp(c) * f * (s.index[0] + 1), "w": c * inputs["e"]}, {"g": graph.tanh(f * c), "still": Node.of(F.lit(2.0))}

    shape, tables = (5, 3, 4), {"f": (field.select("ix", "iy", "iz", "value"), ())}
    moving = {"f": (field.select("ix", "iy", "iz", F.col("moved").alias("value")), ())}
    grid, out = adjoint.scatter_jvp(points, CROSS, kernel, ["c", "e"], shape, {"c": "dc"}, tables, moving, point_key=("p",))
    assert "still_tangent" not in out.columns
    cotangent = (field.select("ix", "iy", "iz", F.col("pulled").alias("value")), ())
    by_grid, by_input = adjoint.scatter_vjp(points, CROSS, kernel, ["c", "e"], shape, {"v": cotangent, "w": cotangent}, {"g": "o"}, tables, point_key=("p",))
    pulled = {(r.ix, r.iy, r.iz): r for r in field.collect()}
    rows = {r.p: r for r in points.collect()}
    left = sum(pulled[(r.ix, r.iy, r.iz)].pulled * (r.v_tangent + r.w_tangent) for r in grid.collect()) + sum(rows[r.p].o * r.g_tangent for r in out.collect())
    right = sum(pulled[(r.ix, r.iy, r.iz)].moved * r.f for r in by_grid.collect()) + sum(rows[r.p].dc * r.c for r in by_input.collect())
    assert left == pytest.approx(right, rel=1e-10) and abs(left) > 1e-3
    want = {}
    for r in rows.values():
        for (j, _, _), o in expand_support(CROSS):
            at = pulled[tuple((c + d) % n for c, d, n in zip((r.cx, r.cy, r.cz), o, shape))]
            want[r.p] = want.get(r.p, 0) + at.pulled * (math.exp(r.c) * at.value * (j + 1) + r.e) + r.o * at.value / math.cosh(at.value * r.c) ** 2
    assert {r.p: r.c for r in by_input.collect()} == pytest.approx(want)
