"""Queries over the driver's tables, one per operator, and the same in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, dual, graph, scalar
from .functions.bspline import bspline
from .functions.complex import Complex, cis
from .functions.dual import Dual
from .functions.graph import Node
from .operators import adjoint
from .operators.adjoint import linear_transpose, scatter_transpose, scatter_vjp, spectral_transpose, spectral_vjp
from .operators.coefficients import coefficients, reference_weights, self_energy
from .operators.coordination import coordination_numbers, edge_geometry, switching
from .operators.kernel import COS8, PI, SIN8, reciprocal_kernel
from .operators.relations import Relation
from .operators.scatter import gather_from_mesh, route, scatter_over_support, scatter_to_mesh
from .operators.spectral import dft, inverse_dft, spectral_map
from .plans import energy as plan
from .plans.model import Model, determinant, inverse
from .sources import tables
from .sources.storage import settled, small_table
from .sources.tables import DAMPING, EIGS, GRID, LATTICE, ORDER, R_CUT, REFERENCES, SELFCONT, SQRT_QZ, V_Q, model

STRAIN = ((0.01, 0.02, 0.0), (0.0, -0.01, 0.015), (0.0, 0.0, 0.005))
CROSS = ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def q(x: Column, scale: float) -> Column:
    """A double as a whole number of units, alike in every engine."""
    return F.floor(x * F.lit(float(scale)) + 0.5).cast("bigint")


# -- SQL of the domain tables -------------------------------------------------


def num(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def sq(x: str, scale: float) -> str:
    return f"CAST(floor(({x}) * {num(scale)} + 0.5) AS BIGINT)"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(num(v) if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


def horner_sql(c: tuple[float, ...], t: str) -> str:
    out = num(c[-1])
    for x in reversed(c[:-1]):
        out = f"({out} * {t} + {num(x)})"
    return out


_E = [f"embedding[{i}]::DOUBLE" for i in (1, 2, 3)]
ATOMS = f"""atoms AS (SELECT vec_id AS atom_id, (label % 3)::INTEGER AS species, {num(0.6)} + {num(0.15)} * (label % 3) AS rcov,
    {", ".join(f"{num(20)} * (37 * {e} - floor(37 * {e})) AS {a}" for e, a in zip(_E, "xyz"))} FROM embeddings)"""
EDGES = """edges AS (SELECT * FROM (SELECT l_orderkey % n AS src, l_partkey % n AS dst, (l_linenumber % 3 - 1)::INTEGER AS sx, (l_suppkey % 3 - 1)::INTEGER AS sy,
    ((l_orderkey + l_partkey) % 3 - 1)::INTEGER AS sz FROM lineitem, (SELECT count(*) AS n FROM embeddings)) WHERE src <> dst OR sx <> 0 OR sy <> 0 OR sz <> 0)"""


def geometry_sql(strain=None) -> str:
    d = [f"(t.{a} - s.{a} + " + " + ".join(f"s{n} * {num(LATTICE[i][c])}" for i, n in enumerate("xyz")) + ")" for c, a in enumerate("xyz")]
    if strain:
        d = [f"({d[a]} + " + " + ".join(f"{d[b]} * {num(strain[b][a])}" for b in range(3)) + ")" for a in range(3)]
    c = f"""geo AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS d FROM (SELECT src, dst, sx, sy, sz, s.rcov + t.rcov AS rc, {d[0]} AS dx, {d[1]} AS dy, {d[2]} AS dz
    FROM edges JOIN atoms s ON s.atom_id = src JOIN atoms t ON t.atom_id = dst)),
    steep AS (SELECT *, greatest(d, (rc + {num(R_CUT)}) / 2) AS far, (rc + {num(R_CUT)}) / 2 AS t0 FROM geo),
    switched AS (SELECT *, 1 / (1 + exp(-(16 + (far - t0) * (far - t0) / (({num(R_CUT)} - far) * ({num(R_CUT)} - far) + 1e-6)) * ({num(4 / 3)} * rc / d - 1))) AS c FROM steep)"""
    return c


CN = "cn AS (SELECT atom_id, coalesce(c, 0) AS cn FROM atoms LEFT JOIN (SELECT src, sum(c) AS c FROM switched GROUP BY src) ON src = atom_id)"
WEIGHTS = f"""refs(species, ref, cnref) AS (VALUES {values(REFERENCES)}),
    logit AS (SELECT atom_id, species, ref, cnref, cn, -4 * (cn - cnref) * (cn - cnref) AS l FROM atoms JOIN cn USING (atom_id) JOIN refs USING (species) WHERE cnref <> -1),
    weights AS (SELECT atom_id, species, ref, cn, cnref, exp(l - max(l) OVER w) / sum(exp(l - m)) OVER w AS w FROM (SELECT *, max(l) OVER (PARTITION BY atom_id) AS m FROM logit) WINDOW w AS (PARTITION BY atom_id))"""
C6 = f"""v_q(species, ref, rank, v) AS (VALUES {values(V_Q)}),
    c6 AS (SELECT atom_id, species, rank, sum(w * v) AS c6 FROM weights JOIN v_q USING (species, ref) GROUP BY ALL)"""
DIMS = f"eigs(rank, eig) AS (VALUES {values(enumerate(EIGS))}), selfcont(species, rank, s) AS (VALUES {values(SELFCONT)}), names(species, sqrt_qz) AS (VALUES {values(SQRT_QZ)})"
_INV = inverse(LATTICE)
MESH = f"""frac AS (SELECT atom_id, species, rcov, {", ".join("(" + " + ".join(f"{c} * {num(_INV[b][a])}" for b, c in enumerate("xyz")) + f") * {num(GRID[a])} AS s{'xyz'[a]}" for a in range(3))} FROM atoms),
    mesh AS (SELECT atom_id, species, rcov, {", ".join(f"floor(s{a})::INTEGER AS c{a}, s{a} - floor(s{a}) AS t{a}" for a in "xyz")} FROM frac)"""
MOD8 = lambda x: f"(((({x}) % 8) + 8) % 8)::INTEGER"
_SP = bspline(ORDER)
AXIS_WEIGHTS = ", ".join(
    f"w{a} AS (" + " UNION ALL ".join(f"SELECT atom_id, {MOD8(f'c{a} + ({o})')} AS i{a}, {horner_sql(_SP.coefficients(k), f't{a}')} AS w{a}, {horner_sql(_SP.coefficients(k, 1), f't{a}')} AS d{a} FROM mesh" for k, o in enumerate(_SP.offsets)) + ")"
    for a in "xyz"
)
RHO = f"""{MESH}, {AXIS_WEIGHTS},
    rho AS (SELECT species, rank, ix, iy, iz, sum(wx * wy * wz * c6) AS rho FROM c6 JOIN wx USING (atom_id) JOIN wy USING (atom_id) JOIN wz USING (atom_id) GROUP BY ALL)"""
BASE = f"WITH {ATOMS}, {EDGES}, {geometry_sql()}, {CN}, {WEIGHTS}, {C6}"
ANGLE = f"{num(2 * PI)} * ((kx * ix + ky * iy + kz * iz) % 8) / 8"


def freqs(half: bool) -> str:
    return f"k AS (SELECT kx::INTEGER AS kx, ky::INTEGER AS ky, kz::INTEGER AS kz FROM range(8) a(kx), range(8) b(ky), range({5 if half else 8}) c(kz))"


def spectrum_sql(half: bool, sign: int = -1) -> str:
    s = "-" if sign < 0 else ""
    return f"{freqs(half)}, spec AS (SELECT species, rank, kx, ky, kz, sum(rho * cos({ANGLE})) AS re, {s}sum(rho * sin({ANGLE})) AS im FROM rho, k GROUP BY ALL)"


_B8 = _SP.fourier_factor(8)
SIGNED = lambda c, half=False: c if half else f"(CASE WHEN {c} < 4 THEN {c} ELSE {c} - 8 END)"
WK = "(CASE WHEN kz = 0 OR kz = 4 THEN 1 ELSE 2 END)"
VOLUME = abs(determinant(LATTICE))


def kernel_sql(k: str, qq: str) -> str:
    p, r = DAMPING, f"({num(DAMPING.a1)} * sqrt(3 * {qq}) + {num(DAMPING.a2)})"
    ks = f"(CASE WHEN {k} < 1e-15 THEN 1 ELSE {k} END)"
    x = f"({ks} * {r})"
    g0 = f"({num(PI**2 * math.sqrt(2) * SIN8)} / pow({r}, 5))"
    return f"""({num(p.s6)} * (CASE WHEN {k} * {r} < 1e-15 THEN {num(2 * PI**2 / 3)} / pow({r}, 3) - {num(2 * PI**2 / 9)} * {r} * {k} * {k}
      ELSE {num(2 * PI**2 / 3)} / ({ks} * pow({r}, 4)) * (exp(-{x}) - 2 * exp(-{x} / 2) * cos({num(PI / 3)} + {x} * {num(math.sqrt(3) / 2)})) END)
      + {qq} * {num(3 * p.s8)} * (CASE WHEN {k} * {r} < 1e-15 THEN {g0} - {g0} * {r} * {r} / 6 * {k} * {k}
      ELSE -{num(PI**2)} / ({ks} * pow({r}, 6)) * (exp(-{x} * {num(SIN8)}) * cos({num(PI / 4)} + {x} * {num(COS8)}) + exp(-{x} * {num(COS8)}) * cos({num(3 * PI / 4)} + {x} * {num(SIN8)})) END))"""


def wave_sql() -> list[str]:
    i = [SIGNED("kx"), SIGNED("ky"), "kz"]
    return [f"{num(2 * PI)} * (" + " + ".join(f"{num(_INV[a][b])} * {i[b]}" for b in range(3)) + ")" for a in range(3)]


_W = wave_sql()
PAIRS = f"""factor(i, b) AS (VALUES {values(enumerate(_B8))}),
    dec AS (SELECT s.*, sqrt_qz, re / (x.b * y.b * z.b) AS cr, im / (x.b * y.b * z.b) AS ci, x.b * y.b * z.b AS fb FROM spec s JOIN names USING (species) JOIN factor x ON x.i = kx JOIN factor y ON y.i = ky JOIN factor z ON z.i = kz),
    waves AS (SELECT kx, ky, kz, {_W[0]} AS gx, {_W[1]} AS gy, {_W[2]} AS gz, sqrt(pow({_W[0]}, 2) + pow({_W[1]}, 2) + pow({_W[2]}, 2) + 1e-36) AS g FROM k),
    kern AS (SELECT a.species AS za, b.species AS zb, w.*, {kernel_sql("w.g", "(a.sqrt_qz * b.sqrt_qz)")} AS kern FROM names a, names b, waves w),
    total AS (SELECT sum({WK} * eig * kern * (a.cr * b.cr + a.ci * b.ci)) AS total FROM kern JOIN dec a ON a.species = za AND a.kx = kern.kx AND a.ky = kern.ky AND a.kz = kern.kz
      JOIN dec b ON b.species = zb AND b.rank = a.rank AND b.kx = kern.kx AND b.ky = kern.ky AND b.kz = kern.kz JOIN eigs ON eigs.rank = a.rank)""".replace(f"{WK} *", "(CASE WHEN kern.kz = 0 OR kern.kz = 4 THEN 1 ELSE 2 END) *")
VSELF = "vself AS (SELECT sum(eig * c6 * c6 * s) AS vself FROM c6 JOIN selfcont USING (species, rank) JOIN eigs USING (rank))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- edges and coefficients ---------------------------------------------------


@query(f"WITH {ATOMS}, {EDGES}, {geometry_sql()}, {CN} SELECT atom_id, {sq('cn', 1e9)} AS cn FROM cn")
def coordination_number(spark, sf_dir):
    m = model(spark, sf_dir)
    return plan.coordination(m).select("atom_id", q(F.col("cn"), 1e9).alias("cn"))


@query(f"WITH {ATOMS}, {EDGES}, {geometry_sql(STRAIN)}, {CN} SELECT atom_id, {sq('cn', 1e9)} AS cn FROM cn")
def coordination_strained(spark, sf_dir):
    m = model(spark, sf_dir)
    return coordination_numbers(m.atoms, m.edges, m.lattice, m.r_cut, STRAIN).select("atom_id", q(F.col("cn"), 1e9).alias("cn"))


@query(f"WITH {ATOMS}, {EDGES}, {geometry_sql()} SELECT src, dst, sx, sy, sz, {sq('d', 1e6)} AS d, {sq('c', 1e12)} AS c FROM switched")
def edge_contributions(spark, sf_dir):
    m = model(spark, sf_dir)
    return edge_geometry(m.atoms, m.edges, m.lattice).select("src", "dst", "sx", "sy", "sz", q(F.col("d"), 1e6).alias("d"), q(switching(F.col("rc"), F.col("d"), m.r_cut), 1e12).alias("c"))


def _weights(m: Model) -> DataFrame:
    return reference_weights(plan.coordination(m), m.atoms, m.references)


@query(f"{BASE} SELECT atom_id, ref::INTEGER AS ref, {sq('w', 1e9)} AS w FROM weights")
def c6_weights(spark, sf_dir):
    return _weights(model(spark, sf_dir)).select("atom_id", "ref", q(F.col("weight"), 1e9).alias("w"))


@query(f"{BASE} SELECT atom_id, rank::INTEGER AS rank, {sq('c6', 1e9)} AS c6 FROM c6")
def c6_coefficients(spark, sf_dir):
    m = model(spark, sf_dir)
    return coefficients(_weights(m), m.v_q).select("atom_id", "rank", q(F.col("c6"), 1e9).alias("c6"))


@query(f"{BASE}, {DIMS}, {VSELF} SELECT {sq('vself', 1e6)} AS vself FROM vself")
def self_energy_total(spark, sf_dir):
    m = model(spark, sf_dir)
    return self_energy(plan.atom_coefficients(m), m.eigs, m.selfcont).select(q(F.col("vself"), 1e6).alias("vself"))


# -- splines, scatter and gather ----------------------------------------------


@query(f"WITH {ATOMS}, {MESH} SELECT atom_id, {', '.join(f'c{a}, {sq(f't{a}', 1e9)} AS t{a}, {MOD8(f'c{a} - 5')} AS w{a}' for a in 'xyz')} FROM mesh")
def mesh_coordinates(spark, sf_dir):
    at = plan.mesh_coordinates(model(spark, sf_dir))
    wrapped = lambda a: F.pmod(F.col(f"c{a}") - 5, F.lit(8)).cast("int").alias(f"w{a}")
    return at.select("atom_id", *(c for a in "xyz" for c in (F.col(f"c{a}"), q(F.col(f"t{a}"), 1e9).alias(f"t{a}"), wrapped(a))))


def _spline_query(order: int):
    spline = bspline(order)
    rows = " UNION ALL ".join(f"SELECT atom_id, {o} AS o, {sq(horner_sql(spline.coefficients(k), 'tx'), 1e9)} AS w, {sq(horner_sql(spline.coefficients(k, 1), 'tx'), 1e9)} AS slope FROM mesh" for k, o in enumerate(spline.offsets))

    def run(spark, sf_dir):
        t = F.col("tx")
        each = [F.struct(F.lit(o).alias("o"), q(w, 1e9).alias("w"), q(d, 1e9).alias("slope")) for o, w, d in zip(spline.offsets, spline.weights(t), spline.weights(t, 1))]
        return plan.mesh_coordinates(model(spark, sf_dir)).select("atom_id", F.explode(F.array(*each)).alias("e")).select("atom_id", "e.*")

    run.__name__ = f"bspline_weights_o{order}"
    query(f"WITH {ATOMS}, {MESH} {rows}")(run)


for _order in (2, 3, 4, 6):
    _spline_query(_order)


def _density(m: Model) -> DataFrame:
    return plan.density(m, plan.atom_coefficients(m))


@query(f"{BASE}, {RHO} SELECT species, rank::INTEGER AS rank, ix, iy, iz, {sq('rho', 1e9)} AS rho FROM rho")
def scatter_density(spark, sf_dir):
    return _density(model(spark, sf_dir)).select("species", "rank", "ix", "iy", "iz", q(F.col("rho"), 1e9).alias("rho"))


@query(f"""WITH {ATOMS}, {MESH}, cross_(i, ox, oy, oz) AS (VALUES {values((i, *o) for i, o in enumerate(CROSS))})
    SELECT {MOD8('cx + ox')} AS ix, {MOD8('cy + oy')} AS iy, {MOD8('cz + oz')} AS iz, {sq('sum((i + 1) * rcov)', 1e6)} AS v FROM mesh, cross_ GROUP BY 1, 2, 3""")
def scatter_nonseparable(spark, sf_dir):
    m = model(spark, sf_dir)
    points = plan.mesh_coordinates(m).join(m.atoms.select("atom_id", "rcov"), "atom_id")
    return scatter_to_mesh(points, CROSS, lambda s: {"v": (s.index[0] + 1) * F.col("rcov")}, GRID).select("ix", "iy", "iz", q(F.col("v"), 1e6).alias("v"))


@query(f"""WITH {ATOMS}, {MESH}, off(o) AS (VALUES (0), (1)), pts AS (SELECT atom_id, rcov, x.o AS ox, {MOD8('cx + x.o')} AS ix, {MOD8('cy + y.o')} AS iy, {MOD8('cz + z.o')} AS iz FROM mesh, off x, off y, off z)
    SELECT ix, iy, iz, count(*) AS n, {sq('sum(rcov * ox)', 1e6)} AS moment FROM pts GROUP BY 1, 2, 3""")
def scatter_two_outputs(spark, sf_dir):
    m = model(spark, sf_dir)
    points = plan.mesh_coordinates(m).join(m.atoms.select("atom_id", "rcov"), "atom_id")
    grid, _ = scatter_over_support(points, (0, 1), lambda s: ({"n": F.lit(1), "moment": F.col("rcov") * s.offset[0]}, None), GRID)
    return grid.select("ix", "iy", "iz", "n", q(F.col("moment"), 1e6).alias("moment"))


GROUPS = [(0, 1), (1, 0), (2, 1)]


@query(f"""WITH {ATOMS}, {MESH}, groups(species, grp) AS (VALUES {values(GROUPS)}), names(grp, name) AS (VALUES (0, 10), (1, 20))
    SELECT name, {MOD8('cx + x')} AS ix, {MOD8('cy + y')} AS iy, {MOD8('cz + z')} AS iz, {sq('sum(rcov)', 1e6)} AS v FROM mesh JOIN groups USING (species) JOIN names USING (grp), range(-1, 2) a(x), range(-1, 2) b(y), range(-1, 2) c(z) GROUP BY 1, 2, 3, 4""")
def scatter_indexed(spark, sf_dir):
    m = model(spark, sf_dir)
    first = small_table(spark, GROUPS, "species int, grp int")
    second = small_table(spark, [(0, 10), (1, 20)], "grp int, name int")
    points = route(plan.mesh_coordinates(m).join(m.atoms.select("atom_id", "rcov"), "atom_id"), (first, "species"), (second, "grp"))
    return scatter_to_mesh(points, (-1, 0, 1), lambda s: {"v": F.col("rcov")}, GRID, batch=("name",)).select("name", "ix", "iy", "iz", q(F.col("v"), 1e6).alias("v"))


GATHER = "SELECT atom_id, rank, sum(wx * wy * wz * rho) AS v FROM c6 JOIN wx USING (atom_id) JOIN wy USING (atom_id) JOIN wz USING (atom_id) JOIN rho USING (species, rank, ix, iy, iz) GROUP BY ALL"


@query(f"{BASE}, {RHO} SELECT atom_id, rank::INTEGER AS rank, {sq('v', 1e6)} AS v FROM ({GATHER})")
def gather_interpolate(spark, sf_dir):
    m = model(spark, sf_dir)
    c6 = plan.atom_coefficients(m)
    grid = plan.density(m, c6).withColumnRenamed("rho", "value")
    out = gather_from_mesh(plan.weighted_points(m, c6), _SP.offsets, lambda s: {"v": s.pick(("wx", "wy", "wz")) * s.grid["g"]}, GRID, grids={"g": (grid, ("species", "rank"))}, point_key=("atom_id", "rank"))
    return out.select("atom_id", "rank", q(F.col("v"), 1e6).alias("v"))


@query(f"{BASE}, {RHO} SELECT atom_id, rank::INTEGER AS rank, {sq('v', 1e6)} AS v FROM ({GATHER})")
def scatter_transposed(spark, sf_dir):
    """The gather as the transpose of the spread."""
    m = model(spark, sf_dir)
    c6 = plan.atom_coefficients(m)
    out = scatter_transpose(plan.weighted_points(m, c6), _SP.offsets, lambda s: s.pick(("wx", "wy", "wz")), plan.density(m, c6).withColumnRenamed("rho", "value"), GRID, ("species", "rank"), ("atom_id", "rank"))
    return out.select("atom_id", "rank", q(F.col("value"), 1e6).alias("v"))


@query(f"""WITH {ATOMS}, {MESH} SELECT species, cell, {sq('sum(rcov)', 1e6)} AS v FROM (SELECT species, rcov, {MOD8('cx - 24 + x')} * 64 + {MOD8('cy - 24 + y')} * 8 + {MOD8('cz + 24 + z')} AS cell
    FROM mesh, range(2) a(x), range(2) b(y), range(2) c(z)) GROUP BY ALL""")
def scatter_batched(spark, sf_dir):
    """A batch per species; cells far outside the grid wrap."""
    m = model(spark, sf_dir)
    points = plan.mesh_coordinates(m).join(m.atoms.select("atom_id", "rcov"), "atom_id").withColumns({"cx": F.col("cx") - 24, "cy": F.col("cy") - 24, "cz": F.col("cz") + 24})
    grid = scatter_to_mesh(points, (0, 1), lambda s: {"v": F.col("rcov")}, GRID, batch=("species",))
    return grid.select("species", (F.col("ix") * 64 + F.col("iy") * 8 + F.col("iz")).alias("cell"), q(F.col("v"), 1e6).alias("v"))


@query(f"""{BASE}, {RHO} SELECT rank, ix, iy, iz, {sq('sum(wx * wy * wz * c6)', 1e6)} AS v, {sq('sum(dx * wy * wz * c6)', 1e6)} AS v_tangent FROM c6 JOIN wx USING (atom_id) JOIN wy USING (atom_id) JOIN wz USING (atom_id) GROUP BY rank, ix, iy, iz""")
def scatter_jvp(spark, sf_dir):
    """The density of every rank and how it changes as all atoms move along the first axis."""
    m = model(spark, sf_dir)
    points = plan.mesh_coordinates(m).drop("species").join(plan.atom_coefficients(m), "atom_id")
    weight = lambda s, a, moving: dual.horner_pick(_SP, Dual(F.col(f"t{a}"), F.lit(1.0 if moving else 0.0)), s.index["xyz".index(a)])
    grid = scatter_to_mesh(points, _SP.offsets, lambda s: (weight(s, "x", True) * weight(s, "y", False) * weight(s, "z", False) * F.col("c6")).outputs("v"), GRID, batch=("rank",))
    return grid.select("rank", "ix", "iy", "iz", q(F.col("v"), 1e6).alias("v"), q(F.col("v_tangent"), 1e6).alias("v_tangent"))


# -- transforms ---------------------------------------------------------------


def _spread(m: Model, c6: DataFrame) -> DataFrame:
    return plan.density(m, c6).select("species", "rank", "ix", "iy", "iz", F.col("rho").alias("c_re"), F.lit(0.0).alias("c_im"))


def _grid(m: Model) -> DataFrame:
    return _density(m).select("species", "rank", "ix", "iy", "iz", F.col("rho").alias("c_re"), F.lit(0.0).alias("c_im"))


KEYS = ("species", "rank")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("species", "rank", F.col("ix").alias("kx"), F.col("iy").alias("ky"), F.col("iz").alias("kz"), q(F.col("c_re"), 1e6).alias("re"), q(F.col("c_im"), 1e6).alias("im"))


SHOWN = f"SELECT species, rank::INTEGER AS rank, kx, ky, kz, {sq('re', 1e6)} AS re, {sq('im', 1e6)} AS im FROM spec"


@query(f"{BASE}, {RHO}, {spectrum_sql(True)} {SHOWN}")
def dft_forward_half(spark, sf_dir):
    return _shown(dft(_grid(model(spark, sf_dir)), GRID, ["c"], keys=KEYS, half=True))


@query(f"{BASE}, {RHO}, {spectrum_sql(False)} {SHOWN}")
def dft_forward_full(spark, sf_dir):
    return _shown(dft(_grid(model(spark, sf_dir)), GRID, ["c"], keys=KEYS))


@query(f"{BASE}, {RHO}, {spectrum_sql(False, 1)} {SHOWN}")
def dft_sign_plus(spark, sf_dir):
    return _shown(dft(_grid(model(spark, sf_dir)), GRID, ["c"], sign=1, keys=KEYS))


_DENSE = "cells AS (SELECT ix::INTEGER AS ix, iy::INTEGER AS iy, iz::INTEGER AS iz FROM range(8) a(ix), range(8) b(iy), range(8) c(iz)), batches AS (SELECT DISTINCT species, rank FROM rho)"


@query(f"{BASE}, {RHO}, {_DENSE} SELECT b.species, b.rank::INTEGER AS rank, c.ix, c.iy, c.iz, {sq('coalesce(rho, 0)', 1e6)} AS rho FROM batches b CROSS JOIN cells c LEFT JOIN rho USING (species, rank, ix, iy, iz)")
def dft_roundtrip(spark, sf_dir):
    there = dft(_grid(model(spark, sf_dir)), GRID, ["c"], keys=KEYS, half=True)
    return inverse_dft(there, GRID, ["c"], keys=KEYS, half=True).select("species", "rank", "ix", "iy", "iz", q(F.col("c_re"), 1e6).alias("rho"))


_FILTER = f"exp(-({' + '.join(f'{SIGNED(c)} * {SIGNED(c)}' for c in ('kx', 'ky', 'kz'))}) / {num(8)})"
_FILTERED = f"""f AS (SELECT kx, ky, kz, {_FILTER} AS f FROM k),
    response AS (SELECT ix, iy, iz, sum(f * cos({ANGLE})) / 512 AS g FROM cells, f GROUP BY ix, iy, iz),
    filtered AS (SELECT species, rank, c.ix, c.iy, c.iz, sum(rho * g) AS v FROM rho r, cells c JOIN response p ON true WHERE p.ix = {MOD8("c.ix - r.ix")} AND p.iy = {MOD8("c.iy - r.iy")} AND p.iz = {MOD8("c.iz - r.iz")} GROUP BY ALL)"""
FILTERED = f"{BASE}, {RHO}, {freqs(False)}, {_DENSE}, {_FILTERED} SELECT species, rank::INTEGER AS rank, ix, iy, iz, {sq('v', 1e6)} AS v FROM filtered"


def _gauss(i) -> Column:
    return F.exp(-(i[0] * i[0] + i[1] * i[1] + i[2] * i[2]) / F.lit(8.0))


@query(FILTERED)
def spectral_filter(spark, sf_dir):
    """A Gaussian filter of the density."""
    back, _ = spectral_map(lambda i, v: ({"c": v["c"].scale(_gauss(i))}, None), _grid(model(spark, sf_dir)), GRID, ["c"], keys=KEYS, is_hermitian=True)
    return back.select("species", "rank", "ix", "iy", "iz", q(F.col("c_re"), 1e6).alias("v"))


@query(FILTERED)
def spectral_transposed(spark, sf_dir):
    """The transpose of the filter; a symmetric filter's is itself."""
    back = spectral_transpose(lambda i: Complex(_gauss(i), F.lit(0.0)), _grid(model(spark, sf_dir)), GRID, ["c"], keys=KEYS)
    return back.select("species", "rank", "ix", "iy", "iz", q(F.col("c_re"), 1e6).alias("v"))


@query(f"{BASE}, {RHO}, {spectrum_sql(True)} SELECT rank::INTEGER AS rank, {sq(f'sum({WK} * (re * re + im * im))', 1e3)} AS power FROM spec GROUP BY rank")
def spectral_aux_sum(spark, sf_dir):
    """The weighted power of the half spectrum, summed over species."""
    _, aux = spectral_map(lambda i, v: (None, {"p": v["c"] * v["c"].conjugate()}), _grid(model(spark, sf_dir)), GRID, ["c"], keys=KEYS, is_hermitian=True, aux_keys=("rank",))
    return aux.select("rank", q(F.col("p_re"), 1e3).alias("power"))


@query(f"{BASE}, {RHO}, {spectrum_sql(True)} SELECT rank::INTEGER AS rank, {sq(f'sum({WK} * 2 * (re * re + im * im))', 1e3)} AS tangent FROM spec GROUP BY rank")
def spectral_jvp(spark, sf_dir):
    """How the power changes as the density grows in proportion: its tangent is the density itself."""

    def power(i, v):
        re, im = (Dual(getattr(v["c"], p), getattr(v["d"], p)) for p in ("re", "im"))
        return None, {"p": Complex((re * re + im * im).tangent, F.lit(0.0))}

    grid = _grid(model(spark, sf_dir)).withColumns({"d_re": F.col("c_re"), "d_im": F.col("c_im")})
    return spectral_map(power, grid, GRID, ["c", "d"], keys=KEYS, is_hermitian=True, aux_keys=("rank",))[1].select("rank", q(F.col("p_re"), 1e3).alias("tangent"))


# -- relations, reduced batches and derivatives of spectral maps --------------

_TUNED = "tune AS (SELECT species, rank, avg(c6) AS g FROM c6 GROUP BY ALL), level AS (SELECT avg(rcov) AS r FROM atoms)"
_SHELL = "(CASE WHEN kx < 4 THEN kx ELSE 8 - kx END + CASE WHEN ky < 4 THEN ky ELSE 8 - ky END + kz)"


def _tuned(m: Model, c6: DataFrame) -> tuple[Relation, Relation, Relation]:
    """By batch, by nothing and by frequency: the mean coefficient, the mean radius, and a weight that falls with the frequency."""
    cells = [(x, y, z, 1 / (1 + min(x, 8 - x) + min(y, 8 - y) + z)) for x in range(8) for y in range(8) for z in range(5)]
    return Relation(c6.groupBy("species", "rank").agg(F.avg("c6").alias("g")), KEYS), Relation(m.atoms.agg(F.avg("rcov").alias("r"))), Relation(small_table(m.atoms.sparkSession, cells, "ix int, iy int, iz int, w double"), ("ix", "iy", "iz"))


@query(f"""{BASE}, {RHO}, {spectrum_sql(True)}, {_TUNED} SELECT rank::INTEGER AS rank, {sq(f'sum({WK} * (re * re + im * im) * g * r / (1 + {_SHELL}))', 1e3)} AS power
    FROM spec JOIN tune USING (species, rank), level GROUP BY rank""")
def spectral_aux_input(spark, sf_dir):
    """A weighted power that reads tables by batch and by frequency, and closes over one of a single row."""
    m = model(spark, sf_dir)
    c6 = settled(plan.atom_coefficients(m), "c6")
    tune, level, cells = _tuned(m, c6)

    def fn(i, v, aux):
        return None, {"p": (v["c"] * v["c"].conjugate()).scale(aux["tune"]["g"] * aux["cells"]["w"] * level["r"])}

    _, sums = spectral_map(fn, _spread(m, c6), GRID, ["c"], keys=KEYS, is_hermitian=True, aux={"tune": tune, "cells": cells}, aux_keys=("rank",))
    return sums.select("rank", q(F.col("p_re"), 1e3).alias("power"))


@query(f"""{BASE}, {RHO}, {freqs(False)}, {_DENSE}, {_FILTERED}, {_TUNED} SELECT rank::INTEGER AS rank, ix, iy, iz, {sq('sum(v * g)', 1e6)} AS v FROM filtered JOIN tune USING (species, rank) GROUP BY ALL""")
def spectral_grid_reduced(spark, sf_dir):
    """Filtered densities of all species, weighted and added before the one transform back."""
    m = model(spark, sf_dir)
    c6 = settled(plan.atom_coefficients(m), "c6")
    tune = _tuned(m, c6)[0]
    back, _ = spectral_map(lambda i, v: ({"c": v["c"].scale(_gauss(i) * tune["g"])}, None), _spread(m, c6), GRID, ["c"], keys=KEYS, is_hermitian=True, grid_keys=("rank",), real=True)
    return back.select("rank", "ix", "iy", "iz", q(F.col("c_re"), 1e6).alias("v"))


_ROTATED = f"""{BASE}, {RHO}, {spectrum_sql(False)}, mixed AS (SELECT a.species, a.kx, a.ky, a.kz, {SIGNED("a.kx")} AS x, {SIGNED("a.ky")} AS y, {SIGNED("a.kz")} AS z, a.re AS ar, a.im AS ai, b.re AS br, b.im AS bi
    FROM spec a JOIN spec b USING (species, kx, ky, kz) WHERE a.rank = 0 AND b.rank = 1),
    turned AS (SELECT *, ar * exp(-x * x / 10.0) - ai * (y / 2.0) + br * (1 + z) - bi * (x - 0.25) AS pr, ar * (y / 2.0) + ai * exp(-x * x / 10.0) + br * (x - 0.25) + bi * (1 + z) AS pi, br * (z / 4.0) - ai AS qr, bi * (z / 4.0) + ar AS qi FROM mixed)"""


def _rotation(i, v):
    """Two grids mixed by factors that are neither real nor even."""
    x, y, z = i
    p = v["a"] * Complex(Node.of(F.exp(-x * x / F.lit(10.0))), Node.of(y / F.lit(2.0))) + v["b"] * Complex(Node.of(1 + z), Node.of(x - F.lit(0.25)))
    return {"p": p, "q": v["b"] * Complex(Node.of(z / F.lit(4.0)), Node.of(0)) + Complex(-v["a"].im, v["a"].re)}, None


def _by_rank(m: Model, names: tuple[str, str], c6: DataFrame) -> DataFrame:
    """The densities of both ranks side by side, as real grids."""
    cells = ("species", "ix", "iy", "iz")
    a, b = (plan.density(m, c6).where(F.col("rank") == r).select(*cells, F.col("rho").alias(f"{v}_re")) for r, v in enumerate(names))
    both = a.join(b, list(cells), "full").na.fill(0.0, [f"{v}_re" for v in names])
    return both.withColumns({f"{v}_im": F.lit(0.0) for v in names})


@query(f"""{_ROTATED} SELECT species, {sq('sum(ar * pr + ai * pi - 2 * (br * qr + bi * qi)) / 512', 1e3)} AS re, {sq('sum(ar * pi - ai * pr - 2 * (br * qi - bi * qr)) / 512', 1e3)} AS im FROM turned GROUP BY species""")
def spectral_rotation_transposed(spark, sf_dir):
    """Sums over cells of the transposed map of (rho 0, -2 rho 1) times the densities, which are those of the map times (rho 0, -2 rho 1)."""
    m = model(spark, sf_dir)
    c6 = settled(plan.atom_coefficients(m), "c6")
    given = _by_rank(m, ("p", "q"), c6).withColumns({"q_re": -2 * F.col("q_re")})
    back = linear_transpose(_rotation, given, GRID, ["a", "b"], {"p": "p", "q": "q"}, keys=("species",))
    met = back.join(_by_rank(m, ("x", "y"), c6).select("species", "ix", "iy", "iz", "x_re", "y_re"), ["species", "ix", "iy", "iz"])
    total = lambda p: q(F.sum(F.col(f"a_{p}") * F.col("x_re") + F.col(f"b_{p}") * F.col("y_re")), 1e3)
    return met.groupBy("species").agg(total("re").alias("re"), total("im").alias("im"))


@query(f"""{BASE}, {RHO}, {spectrum_sql(True)} SELECT species, {sq(f'sum({WK} * ln(1 + a.re * a.re + a.im * a.im))', 1e3)} AS value, {sq(f'sum({WK} * 2 * (a.re * b.re + a.im * b.im) / (1 + a.re * a.re + a.im * a.im))', 1e6)} AS tangent
    FROM spec a JOIN spec b USING (species, kx, ky, kz) WHERE a.rank = 0 AND b.rank = 1 GROUP BY species""")
def spectral_forward(spark, sf_dir):
    """How a sum over the spectrum of one rank changes as that rank's density moves along the other rank's."""
    m = model(spark, sf_dir)
    fn = lambda i, v: (None, {"s": Complex(graph.log1p(v["a"].re * v["a"].re + v["a"].im * v["a"].im), Node.of(0))})
    grid = _by_rank(m, ("a", "d"), settled(plan.atom_coefficients(m), "c6"))
    _, sums = adjoint.spectral_jvp(fn, grid, GRID, ["a"], {"a": "d"}, keys=("species",), is_hermitian=True, aux_keys=("species",))
    return sums.select("species", q(F.col("s_re"), 1e3).alias("value"), q(F.col("s_tangent_re"), 1e6).alias("tangent"))


@query(f"{BASE}, {RHO}, {freqs(False)}, {_DENSE}, {_FILTERED} SELECT species, rank::INTEGER AS rank, ix, iy, iz, {sq('1024 * v', 1e3)} AS v FROM filtered")
def spectral_gradient(spark, sf_dir):
    """The gradient of the filtered power by every cell of the density, swept backwards."""
    fn = lambda i, v: (None, {"s": Complex((v["c"].re * v["c"].re + v["c"].im * v["c"].im) * _gauss(i), Node.of(0))})
    back = spectral_vjp(fn, _grid(model(spark, sf_dir)), GRID, ["c"], aux_cotangents={"s": 1.0}, keys=KEYS, is_hermitian=True)
    return back.select("species", "rank", "ix", "iy", "iz", q(F.col("c_re"), 1e3).alias("v"))


@query(f"""{BASE}, {RHO}, hit AS (SELECT atom_id, rank, species, ix, iy, iz, wx * wy * wz AS w, c6, rho FROM c6 JOIN wx USING (atom_id) JOIN wy USING (atom_id) JOIN wz USING (atom_id) JOIN rho USING (species, rank, ix, iy, iz))
    SELECT 'cell' AS kind, rank::INTEGER AS rank, (species * 512 + ix * 64 + iy * 8 + iz)::BIGINT AS id, {sq('sum(w * tanh(c6))', 1e6)} AS v FROM hit GROUP BY rank, species, ix, iy, iz
    UNION ALL SELECT 'atom', rank::INTEGER, atom_id, {sq('sum(w * rho * (1 - pow(tanh(c6), 2)))', 1e6)} FROM hit GROUP BY rank, atom_id""")
def scatter_backward(spark, sf_dir):
    """For the kernel ``weight * tanh(c6) * grid``, summed per point: the cotangents of its grid and of its coefficients, from one stencil."""
    m = model(spark, sf_dir)
    c6 = settled(plan.atom_coefficients(m), "c6")
    field = plan.density(m, c6).withColumnRenamed("rho", "value")
    kernel = lambda s, inputs, grids: (None, {"v": graph.tanh(inputs["c6"]) * grids["f"] * s.pick(("wx", "wy", "wz"))})
    points = plan.weighted_points(m, c6).withColumn("one", F.lit(1.0))
    by_cell, by_atom = scatter_vjp(points, _SP.offsets, kernel, ["c6"], GRID, cotangents={"v": "one"}, grids={"f": (field, KEYS)}, grid_keys=KEYS, point_key=("atom_id",))
    cells = by_cell.select(F.lit("cell").alias("kind"), "rank", (F.col("species") * 512 + F.col("ix") * 64 + F.col("iy") * 8 + F.col("iz")).cast("bigint").alias("id"), q(F.col("f"), 1e6).alias("v"))
    return cells.unionByName(by_atom.select(F.lit("atom").alias("kind"), "rank", F.col("atom_id").alias("id"), q(F.col("c6"), 1e6).alias("v")))


@query(f"""{BASE}, {RHO} SELECT 'cell' AS kind, rank::INTEGER AS rank, (species * 512 + ix * 64 + iy * 8 + iz)::BIGINT AS id, {sq('sum(wx * wy * wz * c6)', 1e6)} AS v FROM c6 JOIN wx USING (atom_id) JOIN wy USING (atom_id) JOIN wz USING (atom_id) GROUP BY rank, species, ix, iy, iz
    UNION ALL SELECT 'atom', rank::INTEGER, atom_id, {sq('v', 1e6)} FROM ({GATHER})""")
def scatter_and_gather(spark, sf_dir):
    """Spreads coefficients and gathers the density by one kernel: one stencil, one join, one shuffle."""
    m = model(spark, sf_dir)
    c6 = settled(plan.atom_coefficients(m), "c6")
    field = plan.density(m, c6).withColumnRenamed("rho", "value")

    def kernel(s):
        w = s.pick(("wx", "wy", "wz"))
        return {"v": w * F.col("c6")}, {"v": w * s.grid["f"]}

    spread, felt = scatter_over_support(plan.weighted_points(m, c6), _SP.offsets, kernel, GRID, batch=KEYS, grids={"f": (field, KEYS)}, point_key=("atom_id",))
    cells = spread.select(F.lit("cell").alias("kind"), "rank", (F.col("species") * 512 + F.col("ix") * 64 + F.col("iy") * 8 + F.col("iz")).cast("bigint").alias("id"), q(F.col("v"), 1e6).alias("v"))
    return cells.unionByName(felt.select(F.lit("atom").alias("kind"), "rank", F.col("atom_id").alias("id"), q(F.col("v"), 1e6).alias("v")))


# -- kernel, energy and gradients ---------------------------------------------


def _factor_sql(order: int) -> str:
    s = [float(sum(bspline(order).polynomials[k])) for k in range(order)]
    angle = lambda j: f"{num(2 * PI)} * ({j} * k % 8) / 8"
    power = f"pow({' + '.join(f'{num(x)} * cos({angle(j)})' for j, x in enumerate(s[::-1]))}, 2) + pow({' + '.join(f'{num(x)} * sin({angle(j)})' for j, x in enumerate(s[::-1]))}, 2)"
    return f"SELECT {order} AS ord, k::INTEGER AS k, {power} AS p FROM range(8) t(k)"


@query(f"""WITH {ATOMS}, {MESH}, p AS ({" UNION ALL ".join(map(_factor_sql, (2, 3, 4, 6)))}),
    factor AS (SELECT a.ord, a.k, sqrt(CASE WHEN a.k = 4 THEN (b.p + c.p) / 2 ELSE a.p END) AS b FROM p a JOIN p b ON b.ord = a.ord AND b.k = 3 JOIN p c ON c.ord = a.ord AND c.k = 5)
    SELECT atom_id, x.ord AS spline, {sq('x.b * y.b * z.b', 1e9)} AS b FROM mesh JOIN factor x ON x.k = {MOD8('cx')} JOIN factor y ON y.k = {MOD8('cy')} AND y.ord = x.ord JOIN factor z ON z.k = {MOD8('cz')} AND z.ord = x.ord""")
def deconvolution_factor(spark, sf_dir):
    """The Fourier factor of four stencils at the frequency that has the number of every atom's cell."""
    m = model(spark, sf_dir)
    cells = plan.mesh_coordinates(m).select("atom_id", *(F.pmod(F.col(f"c{a}"), F.lit(8)).cast("int").alias(f"i{a}") for a in "xyz"))
    each = [F.struct(F.lit(o).alias("spline"), q(plan.deconvolution(replace(m, order=o)), 1e9).alias("b")) for o in (2, 3, 4, 6)]
    return cells.select("atom_id", F.explode(F.array(*each)).alias("e")).select("atom_id", "e.*")


@query(f"""WITH {ATOMS}, {EDGES}, {geometry_sql()}, {DIMS}
    SELECT src, dst, sx, sy, sz, {sq(kernel_sql('(6 / d)', '(a.sqrt_qz * b.sqrt_qz)'), 1e6)} AS kern FROM geo JOIN atoms s ON s.atom_id = src JOIN atoms t ON t.atom_id = dst JOIN names a ON a.species = s.species JOIN names b ON b.species = t.species""")
def reciprocal_kernels(spark, sf_dir):
    """The kernel for the species of every edge, at a wave number that its length gives."""
    m = model(spark, sf_dir)
    roots = lambda end: m.atoms.select(F.col("atom_id").alias(end), "species").join(m.species.select("species", F.col("sqrt_qz").alias(f"q_{end}")), "species").drop("species")
    met = edge_geometry(m.atoms, m.edges, m.lattice).select("src", "dst", "sx", "sy", "sz", "d").join(roots("dst"), "dst").join(roots("src"), "src")
    return met.select("src", "dst", "sx", "sy", "sz", q(reciprocal_kernel(6 / F.col("d"), F.col("q_src") * F.col("q_dst"), DAMPING), 1e6).alias("kern"))


ENERGY = f"{BASE}, {DIMS}, {RHO}, {spectrum_sql(True)}, {PAIRS}, {VSELF}"


@query(f"{ENERGY} SELECT {sq('total', 1)} AS total FROM total")
def spectral_total(spark, sf_dir):
    m = model(spark, sf_dir)
    return plan.spectral_total(m, plan.spectrum(m, _density(m))).select(q(F.col("total"), 1).alias("total"))


@query(f"{ENERGY} SELECT {sq(f'total / (-2 * {num(VOLUME)}) + vself / 2', 1e4)} AS energy FROM total, vself")
def dispersion_energy(spark, sf_dir):
    """The flagship: energy of the whole system."""
    return plan.dispersion_energy(model(spark, sf_dir)).select(q(F.col("energy"), 1e4).alias("energy"))


def kernel_slope_sql(k: str, qq: str) -> str:
    p, r = DAMPING, f"({num(DAMPING.a1)} * sqrt(3 * {qq}) + {num(DAMPING.a2)})"
    ks = f"(CASE WHEN {k} < 1e-15 THEN 1 ELSE {k} END)"
    x = f"({ks} * {r})"
    phi, alpha, beta = f"({num(PI / 3)} + {x} * {num(math.sqrt(3) / 2)})", f"({num(PI / 4)} + {x} * {num(COS8)})", f"({num(3 * PI / 4)} + {x} * {num(SIN8)})"
    low, high, half = f"exp(-{x} * {num(SIN8)})", f"exp(-{x} * {num(COS8)})", f"exp(-{x} / 2)"
    n6, d6 = f"(exp(-{x}) - 2 * {half} * cos({phi}))", f"({r} * (-exp(-{x}) + {half} * (cos({phi}) + {num(math.sqrt(3))} * sin({phi}))))"
    n8 = f"({low} * cos({alpha}) + {high} * cos({beta}))"
    d8 = f"({r} * (-{num(SIN8)} * {low} * cos({alpha}) - {num(COS8)} * {low} * sin({alpha}) - {num(COS8)} * {high} * cos({beta}) - {num(SIN8)} * {high} * sin({beta})))"
    return f"""(CASE WHEN {k} * {r} < 1e-15 THEN 0 ELSE {num(p.s6 * 2 * PI**2 / 3)} / pow({r}, 4) * ({d6} / {ks} - {n6} / ({ks} * {ks}))
      - {qq} * {num(3 * p.s8 * PI**2)} / pow({r}, 6) * ({d8} / {ks} - {n8} / ({ks} * {ks})) END)"""


_ON = "a.kx = kern.kx AND a.ky = kern.ky AND a.kz = kern.kz"
_AT = "((w.kx * c.ix + w.ky * c.iy + w.kz * c.iz) % 8) / 8"
SLOPES = f"""{ENERGY}, cells AS (SELECT ix::INTEGER AS ix, iy::INTEGER AS iy, iz::INTEGER AS iz FROM range(8) a(ix), range(8) b(iy), range(8) c(iz)),
    field AS (SELECT za AS species, rank, a.kx, a.ky, a.kz, sum(kern * cr) / any_value(fb) AS pr, sum(kern * ci) / any_value(fb) AS pi FROM kern JOIN dec a ON a.species = zb AND {_ON} GROUP BY ALL),
    phi AS (SELECT w.species, w.rank, c.ix, c.iy, c.iz, -any_value(eig) / {num(VOLUME)} * sum((CASE WHEN w.kz = 0 OR w.kz = 4 THEN 1 ELSE 2 END) * (pr * cos({num(2 * PI)} * {_AT}) - pi * sin({num(2 * PI)} * {_AT}))) AS phi
      FROM field w JOIN eigs USING (rank), cells c GROUP BY ALL),
    felt AS (SELECT atom_id, species, rank, c6, sum(phi * wx * wy * wz) AS v, sum(phi * dx * wy * wz) AS ux, sum(phi * wx * dy * wz) AS uy, sum(phi * wx * wy * dz) AS uz
      FROM c6 JOIN wx USING (atom_id) JOIN wy USING (atom_id) JOIN wz USING (atom_id) JOIN phi USING (species, rank, ix, iy, iz) GROUP BY ALL),
    slopes AS (SELECT atom_id, rank, sum(w * (g - gm) * v) AS slope FROM (SELECT *, -8 * (cn - cnref) AS g, sum(w * -8 * (cn - cnref)) OVER (PARTITION BY atom_id) AS gm FROM weights) JOIN v_q USING (species, ref) GROUP BY ALL),
    peratom AS (SELECT atom_id, sum((v + eig * c6 * s) * slope) AS bycn, sum(ux * c6) AS ux, sum(uy * c6) AS uy, sum(uz * c6) AS uz FROM felt JOIN slopes USING (atom_id, rank) JOIN eigs USING (rank) JOIN selfcont USING (species, rank) GROUP BY atom_id),
    slope0 AS (SELECT *, ({num(R_CUT)} - far) * ({num(R_CUT)} - far) + 1e-6 AS q, {num(4 / 3)} * rc AS rest FROM switched),
    pulls AS (SELECT src, dst, dx, dy, dz, bycn / d * c * (1 - c) * ((CASE WHEN d > t0 THEN (2 * (far - t0) * q + 2 * (far - t0) * (far - t0) * ({num(R_CUT)} - far)) / (q * q) ELSE 0 END) * (rest / d - 1)
      - (16 + (far - t0) * (far - t0) / q) * rest / (d * d)) AS pull FROM slope0 JOIN peratom ON atom_id = src)"""
_MESH_GRADIENT = [" + ".join(f"{num(_INV[a][b] * GRID[b])} * u{c}" for b, c in enumerate("xyz")) for a in range(3)]


@query(f"""{SLOPES}, ends AS (SELECT dst AS atom_id, pull * dx AS fx, pull * dy AS fy, pull * dz AS fz FROM pulls UNION ALL SELECT src, -pull * dx, -pull * dy, -pull * dz FROM pulls),
    forces AS (SELECT atom_id, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM ends GROUP BY atom_id)
    SELECT atom_id, {", ".join(sq(f"{_MESH_GRADIENT[i]} + coalesce(f{a}, 0)", 1e6) + f" AS g{a}" for i, a in enumerate("xyz"))} FROM peratom LEFT JOIN forces USING (atom_id)""")
def energy_position_gradient(spark, sf_dir):
    by_position = plan.energy_gradients(model(spark, sf_dir))[0]
    return by_position.select("atom_id", *(q(F.col(f"g{a}"), 1e6).alias(f"g{a}") for a in "xyz"))


_PAIR_SLOPE = kernel_slope_sql("w.g", "(x.sqrt_qz * y.sqrt_qz)")
_STRAIN_ROWS = " UNION ALL ".join(
    f"""SELECT {i} AS row, {j} AS col, {sq(f"(SELECT sum(e * g{'xyz'[i]} * g{'xyz'[j]} / g) FROM bent) / {num(2 * VOLUME)} + (SELECT sum(pull * d{'xyz'[i]} * d{'xyz'[j]}) FROM pulls)" + (f" + (SELECT total FROM total) / {num(2 * VOLUME)}" if i == j else ""), 1e3)} AS g"""
    for i in range(3) for j in range(3)
)


@query(f"""{SLOPES}, bends AS (SELECT x.species AS za, y.species AS zb, w.*, {_PAIR_SLOPE} AS kern FROM names x, names y, waves w),
    bent AS (SELECT kern.gx, kern.gy, kern.gz, kern.g, (CASE WHEN kern.kz = 0 OR kern.kz = 4 THEN 1 ELSE 2 END) * eig * kern * (a.cr * b.cr + a.ci * b.ci) AS e FROM bends kern JOIN dec a ON a.species = za AND {_ON}
      JOIN dec b ON b.species = zb AND b.rank = a.rank AND b.kx = kern.kx AND b.ky = kern.ky AND b.kz = kern.kz JOIN eigs ON eigs.rank = a.rank) {_STRAIN_ROWS}""")
def energy_strain_gradient(spark, sf_dir):
    return plan.energy_gradients(model(spark, sf_dir))[1].select("row", "col", q(F.col("g"), 1e3).alias("g"))


# -- scalar expressions over the order lines ----------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("t"), F.col("l_extendedprice").alias("p"))


LINES = "WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey, l_suppkey, l_quantity AS a, l_discount AS b, l_tax AS t, l_extendedprice AS p FROM lineitem)"
X, Y = "(a - 25)", "(b * 10)"
UNARY = {
    "neg": (lambda x, y: -x, f"-{X}", 1e6), "abs": (lambda x, y: F.abs(x), f"abs({X})", 1e6), "sgn": (lambda x, y: scalar.sign(x), f"sign({X})", 1),
    "exp_": (lambda x, y: F.exp(y), f"exp({Y})", 1e6), "log_": (lambda x, y: scalar.log(y + 1), f"ln({Y} + 1)", 1e6), "sqrt_": (lambda x, y: scalar.sqrt(y), f"sqrt({Y})", 1e6),
    "rsqrt_": (lambda x, y: scalar.rsqrt(y + 1), f"1 / sqrt({Y} + 1)", 1e6), "sine": (lambda x, y: F.sin(x), f"sin({X})", 1e6), "cosine": (lambda x, y: F.cos(x), f"cos({X})", 1e6),
    "tan_": (lambda x, y: F.tan(y), f"tan({Y})", 1e6), "tanh_": (lambda x, y: F.tanh(y), f"tanh({Y})", 1e6), "floor_": (lambda x, y: scalar.floor(x / 3), f"floor({X} / 3)", 1),
    "ceil_": (lambda x, y: scalar.ceil(x / 3), f"ceil({X} / 3)", 1), "expm1_": (lambda x, y: F.expm1(y), f"exp({Y}) - 1", 1e6), "log1p_": (lambda x, y: scalar.log1p(y), f"ln(1 + {Y})", 1e6),
    "even": (lambda x, y: scalar.round_even(x / 2), f"round_even({X} / 2, 0)", 1), "away": (lambda x, y: scalar.round_away(x / 2), f"round({X} / 2)", 1), "asin_": (lambda x, y: F.asin(y / 10), f"asin({Y} / 10)", 1e6),
    "acos_": (lambda x, y: F.acos(y / 10), f"acos({Y} / 10)", 1e6), "atan_": (lambda x, y: F.atan(x), f"atan({X})", 1e6), "sinh_": (lambda x, y: F.sinh(y), f"sinh({Y})", 1e6), "cosh_": (lambda x, y: F.cosh(y), f"cosh({Y})", 1e6),
    "asinh_": (lambda x, y: F.asinh(x), f"asinh({X})", 1e6), "acosh_": (lambda x, y: F.acosh(y + 1), f"acosh({Y} + 1)", 1e6), "atanh_": (lambda x, y: F.atanh(y / 10), f"atanh({Y} / 10)", 1e6),
    "logistic_": (lambda x, y: scalar.logistic(x), f"1 / (1 + exp(-{X}))", 1e6), "square_": (lambda x, y: scalar.square(x), f"{X} * {X}", 1),
}


@query(f"{LINES} SELECT o, n, {', '.join(f'{sq(s, k)} AS {c}' for c, (_, s, k) in UNARY.items())} FROM l")
def expr_unary(spark, sf_dir):
    x, y = F.col("a") - 25, F.col("b") * 10
    return _lines(spark, sf_dir).select("o", "n", *(q(f(x, y), k).alias(c) for c, (f, _, k) in UNARY.items()))


NULLABLE = f"(CASE WHEN {X} % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE {X} END)"


@query(f"""{LINES} SELECT o, n, {sq(f'CASE WHEN t = 0 THEN 0 ELSE {X} / t END', 1e6)} AS quotient, t = 0 AND {X} <> 0 AS infinite, {sq(f'{X} % 7', 1e6)} AS rest,
    {sq(f'CASE WHEN {X} % 7 = 0 THEN {Y} ELSE greatest({X}, {Y}) END', 1e6)} AS larger, {sq(f'CASE WHEN {X} % 7 = 0 THEN {Y} ELSE least({X}, {Y}) END', 1e6)} AS smaller,
    {sq(f'pow({Y} + 1, t * 10)', 1e6)} AS power, {sq(f'least(greatest({X}, -3), 4)', 1e6)} AS clamped, {X} % 7 = 0 OR {X} <> {Y} AS differs, {X} % 7 <> 0 AND {X} < {Y} AS less, {sq(f'CASE WHEN n % 4 = 0 THEN {X} WHEN n % 4 = 1 THEN {Y} ELSE t END', 1e6)} AS chosen,
    trunc((l_partkey - 500) / 7.0)::BIGINT AS whole FROM l""")
def expr_binary(spark, sf_dir):
    x, y, t = F.col("a") - 25, F.col("b") * 10, F.col("t")
    odd = F.when(x % 7 == 0, F.lit(float("nan"))).otherwise(x)
    quotient = scalar.divide(x, t)
    return _lines(spark, sf_dir).select(
        "o", "n", F.when(scalar.is_finite(quotient), q(quotient, 1e6)).otherwise(F.lit(0)).alias("quotient"), (~scalar.is_finite(quotient) & ~F.isnan(quotient)).alias("infinite"), q(scalar.remainder(x, F.lit(7.0)), 1e6).alias("rest"),
        q(scalar.maximum(odd, y), 1e6).alias("larger"), q(scalar.minimum(odd, y), 1e6).alias("smaller"), q(F.pow(y + 1, t * 10), 1e6).alias("power"), q(scalar.clamp(x, F.lit(-3.0), F.lit(4.0)), 1e6).alias("clamped"),
        scalar.compare("NE", odd, y).alias("differs"), scalar.compare("LT", odd, y).alias("less"), q(scalar.case(F.col("n") % 4, [x, y, t]), 1e6).alias("chosen"), scalar.int_divide(F.col("l_partkey") - 500, F.lit(7)).alias("whole"),
    )


@query(f"""{LINES}, i AS (SELECT o, n, (l_partkey - 100)::INTEGER AS x, l_suppkey::INTEGER AS y FROM l) SELECT o, n, x & y AS both, x | y AS either, xor(x, y) AS one, ~x AS inverse, (x::BIGINT * 8)::INTEGER AS up, (floor(x / 4.0))::INTEGER AS down,
    (CASE WHEN x < 0 THEN (x::BIGINT + 4294967296) // 16 ELSE x // 16 END)::INTEGER AS logical, bit_count(x)::INTEGER AS ones, (CASE WHEN x < 0 THEN 0 WHEN x = 0 THEN 32 ELSE 32 - length(bin(x)) END)::INTEGER AS zeros FROM i""")
def expr_bits(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    lines = _lines(spark, sf_dir).select("o", "n", (F.col("l_partkey") - 100).cast("int").alias("x"), F.col("l_suppkey").cast("int").alias("y"))
    return lines.select("o", "n", x.bitwiseAND(y).alias("both"), x.bitwiseOR(y).alias("either"), x.bitwiseXOR(y).alias("one"), F.bitwise_not(x).alias("inverse"), F.shiftleft(x, 3).alias("up"), F.shiftright(x, 2).alias("down"),
        F.shiftrightunsigned(x, 4).alias("logical"), scalar.popcount(x).alias("ones"), scalar.count_leading_zeros(x).alias("zeros"))


@query(f"""{LINES} SELECT o, n, {sq(f'{X} * t - {Y} * 2', 1e6)} AS product_re, {sq(f'{X} * 2 + {Y} * t', 1e6)} AS product_im, {sq(f'({X} * t + {Y} * 2) / (t * t + 4)', 1e6)} AS quotient_re, {sq(f'({Y} * t - {X} * 2) / (t * t + 4)', 1e6)} AS quotient_im,
    {sq(f'sqrt({X} * {X} + {Y} * {Y})', 1e6)} AS size, {sq(f'{X} * {X} - {Y} * {Y}', 1e6)} AS square_re, {sq(f'-{Y}', 1e6)} AS conjugate_im FROM l""")
def expr_complex(spark, sf_dir):
    z, w = Complex(F.col("a") - 25, F.col("b") * 10), Complex(F.col("t"), F.lit(2.0))
    product, quotient = z * w, z / w
    parts = {"product_re": product.re, "product_im": product.im, "quotient_re": quotient.re, "quotient_im": quotient.im, "size": z.abs(), "square_re": z.square().re, "conjugate_im": z.conjugate().im}
    return _lines(spark, sf_dir).select("o", "n", *(q(v, 1e6).alias(c) for c, v in parts.items()))


@query(f"{LINES} SELECT o, n, trunc({X} / 4)::BIGINT AS whole, {X} > 0 AS positive, ({X} > 0)::INTEGER AS flag, (n * 3)::DOUBLE AS wide, (b::FLOAT)::DOUBLE AS single FROM l")
def expr_cast(spark, sf_dir):
    x = F.col("a") - 25
    return _lines(spark, sf_dir).select("o", "n", scalar.to_int(x / 4).alias("whole"), (x > 0).alias("positive"), (x > 0).cast("int").alias("flag"), (F.col("n") * 3).cast("double").alias("wide"), F.col("b").cast("float").cast("double").alias("single"))


V6 = "[n, l_partkey % 11, l_suppkey % 7, o % 5, n * 2, l_partkey % 3]"


def _six(c: str = "v") -> Column:
    items = ("n", "l_partkey % 11", "l_suppkey % 7", "o % 5", "n * 2", "l_partkey % 3")
    return F.array(*[F.expr(i).cast("bigint") for i in items]).alias(c)


_text = lambda a: F.array_join(a.cast("array<string>"), ",")
_list = lambda *x: "concat_ws(',', " + ", ".join(x) + ")"
E6 = [f"v[{i}]" for i in range(1, 7)]


@query(f"""{LINES}, s AS (SELECT o, n, {V6} AS v FROM l) SELECT o, n, {_list(E6[1], E6[3], E6[5])} AS sliced, {_list(*(E6[i] for i in (0, 3, 1, 4, 2, 5)))} AS transposed, {_list(*E6[::-1])} AS reversed,
    {_list("-1", E6[0], "-1", E6[1], "-1", E6[2], "-1", E6[3], "-1", E6[4], "-1")} AS padded, array_to_string(v[least(greatest(n - 2, 0), 3) + 1:least(greatest(n - 2, 0), 3) + 3], ',') AS dynamic,
    array_to_string([CASE WHEN i - 1 >= least(n, 4) AND i - 1 < least(n, 4) + 2 THEN 100 + i - 1 - least(n, 4) ELSE v[i] END FOR i IN range(1, 7)], ',') AS updated, {_list("v[least(n, 5) + 1]", E6[0], E6[5])} AS gathered, array_to_string([v[i] + CASE WHEN i - 1 = o % 8 THEN 10 ELSE 0 END + CASE WHEN i - 1 = 2 THEN 5 ELSE 0 END FOR i IN range(1, 7)], ',') AS scattered FROM s""")
def expr_array(spark, sf_dir):
    v, n = F.col("v"), F.col("n")
    padded = arrays.pad(v, 6, F.lit(-1).cast("bigint"), low=1, high=0, interior=1)
    return _lines(spark, sf_dir).select("o", "n", _six()).select(
        "o", "n", _text(arrays.slice_(v, 1, 6, 2)).alias("sliced"), _text(arrays.transpose(v, 2, 3)).alias("transposed"), _text(F.reverse(v)).alias("reversed"), _text(F.slice(padded, 1, 11)).alias("padded"),
        _text(arrays.dynamic_slice(v, n - 2, 6, 3)).alias("dynamic"), _text(arrays.dynamic_update(v, F.array(F.lit(100), F.lit(101)).cast("array<bigint>"), n, 6, 2)).alias("updated"),
        _text(arrays.gather(v, F.array(n, F.lit(-4), F.lit(77)), 6)).alias("gathered"), _text(arrays.scatter(v, F.array((F.col("o") % 8).cast("int"), F.lit(2)), F.array(F.lit(10), F.lit(5)).cast("array<bigint>"), lambda a, u: a + u)).alias("scattered"),
    )


@query(f"""{LINES}, s AS (SELECT o, n, {V6} AS v FROM l) SELECT o, n, list_sum(v)::BIGINT AS total, list_max(v) AS largest, {sq(' + '.join(f'{E6[i]} * {E6[i]}' for i in range(6)), 1)} AS dotted,
    {_list(*(f"greatest({', '.join(E6[j] for j in (i, i + 2))})" for i in range(4)))} AS windows, {_list(*(f"({E6[r * 3]} * {E6[c]} + {E6[r * 3 + 1]} * {E6[2 + c]} + {E6[r * 3 + 2]} * {E6[4 + c]})::BIGINT" for r in range(2) for c in range(2)))} AS product FROM s""")
def expr_reduce(spark, sf_dir):
    v = F.col("v")
    zero = F.lit(0).cast("bigint")
    windows = arrays.reduce_window(v, 6, 2, F.lit(-1).cast("bigint"), lambda a, x: F.greatest(a, x), dilation=2)
    as_double = v.cast("array<double>")
    return _lines(spark, sf_dir).select("o", "n", _six()).select(
        "o", "n", arrays.reduce(v, zero, lambda a, x: a + x).alias("total"), arrays.reduce(v, zero, lambda a, x: F.greatest(a, x)).alias("largest"), q(arrays.dot(as_double, as_double), 1).alias("dotted"), _text(windows).alias("windows"),
        _text(arrays.matmul(as_double, as_double, 2, 3, 2).cast("array<bigint>")).alias("product"),
    )


@query(f"""{LINES}, s AS (SELECT o, n, list_sort([{{'x': ({V6})[i], 'i': i - 1}} FOR i IN range(1, 7)]) AS e FROM l)
    SELECT o, n, array_to_string([r.x FOR r IN e], ',') AS sorted, array_to_string([r.i FOR r IN e], ',') AS places FROM s""")
def expr_sort(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("o", "n", _six())
    keys, places = arrays.sort_by(F.col("v"), arrays.iota(6))
    return lines.select("o", "n", _text(keys).alias("sorted"), _text(places).alias("places"))


# Two rows of three, or three rows of two, of the six numbers of a line.
_R23 = [[f"v[{r * 3 + c + 1}]" for c in range(3)] for r in range(2)]
_R32 = [[f"v[{r * 2 + c + 1}]" for c in range(2)] for r in range(3)]
_P2 = "least(greatest(n - 2, 0), 1)"


@query(f"""{LINES}, s AS (SELECT o, n, {V6} AS v FROM l) SELECT o, n,
    {_list(*(f"({' + '.join(f'{_R32[k][i]} * {_R32[k][j]}' for k in range(3))})::BIGINT" for i in range(2) for j in range(2)))} AS contracted,
    {_list(*(f"({_R32[k][i]} * {_R23[i][k]})::BIGINT" for k in range(3) for i in range(2)))} AS batched,
    {_list(*(f"({' + '.join(f'{_R23[r][c]} * (CASE WHEN {c} % 2 = 0 THEN {_R23[r][c]} ELSE 0 END) - (CASE WHEN {c} % 2 = 0 THEN 0 ELSE {_R23[r][c]} * {_R23[r][c]} END)' for c in range(3))})::BIGINT" for r in range(2)))} AS complex_re,
    {_list(*(f"greatest({', '.join(_R23[r][c] for r in range(2))})" for c in range(3)))} AS columns_max,
    {_list(*("(" + " + ".join(_R23[r + i][c] for i in range(2) for c in range(j - 1, j + 2, 2) if r + i < 2 and 0 <= c < 3) + ")::BIGINT" for r in range(2) for j in range(3)))} AS windows,
    {_list(*(f"v[least(greatest(n - 3, 0), 1) * 3 + {c} + {_P2} + 1]" for c in range(2)))} AS gathered,
    {_list(*(f"(v[{i * 3 + j + 1}] + CASE WHEN {i} = n - 3 AND {j} BETWEEN o % 3 AND o % 3 + 1 THEN 100 + {j} - o % 3 ELSE 0 END)::BIGINT" for i in range(2) for j in range(3)))} AS scattered,
    {_list(*(_R23[r][c] for c in range(3) for r in range(2) for _ in range(2)))} AS spread FROM s""")
def expr_axes(spark, sf_dir):
    """Arrays of several axes: contractions, folds, windows, gathers and scatters."""
    v, n, pairs = F.col("v"), F.col("n"), F.col("pairs")
    whole = lambda a: _text(a.cast("array<bigint>"))
    add = lambda x, y: x + y
    # Numbers in even columns are real, the others imaginary.
    made = [Complex(arrays.at(v, i), F.lit(0.0)) if i % 3 % 2 == 0 else Complex(F.lit(0.0), arrays.at(v, i)) for i in range(6)]
    lines = _lines(spark, sf_dir).select("o", "n", _six()).select("o", "n", v.cast("array<double>").alias("v")).select("o", "n", "v", F.array(*[z.struct() for z in made]).alias("pairs"))
    of = lambda x: Complex(x["re"], x["im"])
    squared = arrays.dot_general(pairs, pairs, (2, 3), (2, 3), ((1,), (1,)), ((0,), (0,)), Complex(F.lit(0.0), F.lit(0.0)).struct(), lambda x, y: (of(x) * of(y)).struct(), lambda x, y: (of(x) + of(y)).struct())
    starts = F.array((n - 3).cast("int"), (n - 2).cast("int"))
    begin = F.array((n - 3).cast("int"), (F.col("o") % 3).cast("int"))
    kept = arrays.scatter_nd(v, (2, 3), begin, (1, 2), F.array(F.lit(100.0), F.lit(101.0)), (1, 2), add, (1,), (0,), (0, 1), 1)
    return lines.select(
        "o", "n", whole(arrays.dot_general(v, v, (3, 2), (3, 2), ((0,), (0,)))).alias("contracted"), whole(arrays.dot_general(v, v, (3, 2), (2, 3), ((), ()), ((0, 1), (1, 0)))).alias("batched"),
        whole(squared["re"]).alias("complex_re"), whole(arrays.fold_axes([v], (2, 3), (0,), F.lit(-1.0), F.greatest)).alias("columns_max"),
        whole(arrays.fold_windows([v], (2, 3), (2, 2), F.lit(0.0), add, dilation=(1, 2), padding=((0, 1), (1, 1)))).alias("windows"),
        whole(arrays.gather_nd(v, (2, 3), starts, (2,), (1, 2), (0,), (0,), (0, 1), 0)).alias("gathered"), whole(kept).alias("scattered"),
        whole(arrays.broadcast_in_dim(arrays.permute(v, (2, 3), (1, 0)), (3, 2, 1), (3, 2, 2), (0, 1, 2))).alias("spread"),
    )


_WIDE_A, _WIDE_B = "((l_partkey % 1000 - 500) * 9007199254740993 + o * 131)::BIGINT", "((l_suppkey - 50) * 72057594037927 - o * 7 - 1)::BIGINT"
_WRAP = lambda x: f"(CASE WHEN ({x}) & 18446744073709551615::HUGEINT >= 9223372036854775808 THEN (({x}) & 18446744073709551615::HUGEINT) - 18446744073709551616 ELSE ({x}) & 18446744073709551615::HUGEINT END)::BIGINT"


@query(f"""{LINES}, i AS (SELECT o, n, {_WIDE_A}::HUGEINT AS x, {_WIDE_B}::HUGEINT AS y FROM l), w AS (SELECT *, x * y AS p, x * 3 + y * 3 AS s, x - y AS d FROM i)
    SELECT o, n, {_WRAP("p")} AS product, abs(p) > 9223372036854775807 AS beyond, {_WRAP("s")} AS total, {_WRAP("d")} AS difference FROM w""")
def expr_wide(spark, sf_dir):
    """Sums, differences and products of longs that wrap around."""
    x, y, three = F.col("x"), F.col("y"), F.lit(3).cast("bigint")
    lines = _lines(spark, sf_dir).select("o", "n", ((F.col("l_partkey") % 1000 - 500) * F.lit(9007199254740993) + F.col("o") * 131).cast("bigint").alias("x"), ((F.col("l_suppkey") - 50) * F.lit(72057594037927) - F.col("o") * 7 - 1).cast("bigint").alias("y"))
    product = scalar.wrapping_multiply(x, y)
    beyond = F.abs(x.cast("decimal(38,0)") * y.cast("decimal(38,0)")) > F.lit("9223372036854775807").cast("decimal(38,0)")
    return lines.select("o", "n", product.alias("product"), beyond.alias("beyond"), scalar.wrapping_add(scalar.wrapping_multiply(x, three), scalar.wrapping_multiply(y, three)).alias("total"), scalar.wrapping_subtract(x, y).alias("difference"))


@query(f"""{LINES}, s AS (SELECT o, n, {V6} AS v, {X} AS x, {Y} AS y FROM l), r AS (SELECT o, n, v, x, y, list_sort([{{'k': -v[i], 'i': i - 1}} FOR i IN range(1, 7)]) AS e FROM s)
    SELECT o, n, array_to_string([-z.k FOR z IN e], ',') AS falling, array_to_string([z.i FOR z IN e], ',') AS places, list_sum([v[i] * (i - 1) FOR i IN range(1, 7)])::BIGINT AS weighted, list_max(v) AS largest,
    {_list(*(E6[i] for i in (0, 1, 2, 3, 4, 5, 0, 1)))} AS joined, x = y AND y = 2 AS same, x <> y OR y <> 2 AS differ, {sq('cos(x) * y', 1e6)} AS turned, (x + 1) * 8 - 1 AS looped,
    ((((l3 % 256) + 256) % 256 + 128) % 256 - 128)::INTEGER AS small FROM (SELECT *, (v[2] * 37 + v[3] * 11)::BIGINT AS l3 FROM r)""")
def expr_helpers(spark, sf_dir):
    """Sorting by a comparator, folding arrays together, complex equality and rotation, loops, and small integers that wrap."""
    v, x, y = F.col("v"), F.col("x"), F.col("y")
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(-1).cast("bigint").alias("m"))
    lines = _lines(spark, sf_dir).select("o", "n", _six(), (F.col("a") - 25).alias("x"), (F.col("b") * 10).alias("y"))
    falling, places = arrays.sort_with(lambda p, r: p["f0"] > r["f0"], v, arrays.iota(6))
    both = arrays.reduce_rows(zero, lambda acc, r: F.struct((acc["s"] + r["f0"] * r["f1"]).alias("s"), F.greatest(acc["m"], r["f0"]).alias("m")), v, arrays.iota(6).cast("array<bigint>"))
    z, w = Complex(x, y), Complex(y, F.lit(2.0))
    looped = scalar.repeat(3, lambda i, s: s * 2 + 1, x)
    return lines.select(
        "o", "n", _text(falling).alias("falling"), _text(places).alias("places"), both["s"].alias("weighted"), both["m"].alias("largest"), _text(arrays.concatenate(v, F.slice(v, 1, 2))).alias("joined"),
        z.equals(w).alias("same"), z.differs(w).alias("differ"), q((cis(x).scale(y)).re, 1e6).alias("turned"), looped.alias("looped"),
        scalar.wrapping(lambda p, r: p + r, F.get(v, F.lit(1)) * 37, F.get(v, F.lit(2)) * 11, 8).cast("int").alias("small"),
    )


@query(None)
def expr_special(spark, sf_dir):
    """Error functions and the bits of doubles, which have no SQL."""
    b = F.col("b")
    return _lines(spark, sf_dir).select("o", "n", q(scalar.erf(b * 10), 1e6).alias("erf"), q(scalar.erfc(b * 10), 1e6).alias("erfc"), scalar.double_bits(b).alias("bits"), q(scalar.bits_double(scalar.double_bits(b)), 1e6).alias("back"))
