"""The dispersion energy of a periodic system, and its gradients, as DataFrame pipelines."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bspline import bspline
from ..functions.complex import Complex
from ..operators.coefficients import coefficients, reference_weights, self_energy
from ..operators.coordination import coordination_numbers, edge_geometry, switching_slope
from ..operators.kernel import Damping, reciprocal_kernel, reciprocal_kernel_slope
from ..operators.relations import Relation
from ..operators.scatter import CELLS, gather_from_mesh, scatter_to_mesh
from ..operators.spectral import dft, frequency, inverse_dft, map_spectrum
from ..sources.storage import settled
from .model import Matrix, Model, inverse

#: Densities and spectra have a batch per species and rank.
BATCH = ("species", "rank")
#: A frequency's wave vector and its length.
WAVES = ("kx", "ky", "kz", "k")


def mesh_coordinates(model: Model) -> DataFrame:
    """``(atom_id, species, cx, cy, cz, tx, ty, tz)``: cell and fraction of every atom; cells may lie outside the grid."""
    inv, out = inverse(model.lattice), []
    for a, n in enumerate(model.grid_shape):
        s = sum((F.col(c) * F.lit(inv[b][a]) for b, c in ((1, "y"), (2, "z"))), F.col("x") * F.lit(inv[0][a])) * float(n)
        out.append(s.alias(f"s{'xyz'[a]}"))
    placed = model.atoms.select("atom_id", "species", *out)
    cells = [F.floor(f"s{a}").cast("int").alias(f"c{a}") for a in "xyz"]
    return placed.select("atom_id", "species", *cells, *((F.col(f"s{a}") - F.floor(f"s{a}")).alias(f"t{a}") for a in "xyz"))


def coordination(model: Model) -> DataFrame:
    return coordination_numbers(model.atoms, model.edges, model.lattice, model.r_cut)


def atom_coefficients(model: Model) -> DataFrame:
    return coefficients(reference_weights(coordination(model), model.atoms, model.references), model.v_q)


def weighted_points(model: Model, c6: DataFrame, slopes: bool = False) -> DataFrame:
    """Points for the mesh: a row per atom and rank with spline weights per axis, computed before the stencil is expanded."""
    spline = bspline(model.order)
    at = mesh_coordinates(model).drop("species")
    arrays = [F.array(*spline.weights(F.col(f"t{a}"))).alias(f"w{a}") for a in "xyz"]
    arrays += [F.array(*spline.weights(F.col(f"t{a}"), 1)).alias(f"d{a}") for a in "xyz"] if slopes else []
    return at.select("atom_id", "cx", "cy", "cz", *arrays).join(c6, "atom_id")


def density(model: Model, c6: DataFrame) -> DataFrame:
    """``(species, rank, ix, iy, iz, rho)``: coefficients spread over the mesh."""
    spline = bspline(model.order)
    points = weighted_points(model, c6)
    return scatter_to_mesh(points, spline.offsets, lambda s: {"rho": s.pick(("wx", "wy", "wz")) * F.col("c6")}, model.grid_shape, batch=("species", "rank"))


def deconvolution(model: Model) -> Column:
    """The stencil's Fourier factor at ``ix iy iz``."""
    spline = bspline(model.order)
    factors = [F.get(F.array(*map(F.lit, spline.fourier_factor(n))), F.col(c)) for c, n in zip(CELLS, model.grid_shape)]
    return factors[0] * factors[1] * factors[2]


def wave_vector(model: Model) -> tuple[Column, Column, Column, Column]:
    """``kx ky kz`` and their length at ``ix iy iz`` of the half spectrum."""
    inv = inverse(model.lattice)
    i = [frequency(F.col(c), n, c == "iz") for c, n in zip(CELLS, model.grid_shape)]
    k = [2 * math.pi * (F.lit(inv[a][0]) * i[0] + F.lit(inv[a][1]) * i[1] + F.lit(inv[a][2]) * i[2]) for a in range(3)]
    return (*k, F.sqrt(k[0] * k[0] + k[1] * k[1] + k[2] * k[2] + 1e-36))


def spectrum(model: Model, rho: DataFrame) -> DataFrame:
    """``(species, rank, ix, iy, iz, c_re, c_im)``: the deconvolved half spectrum of the density."""
    grid = rho.select("species", "rank", *CELLS, F.col("rho").alias("c_re"), F.lit(0.0).alias("c_im"))
    out = dft(grid, model.grid_shape, ["c"], keys=("species", "rank"), half=True)
    b = deconvolution(model)
    return out.select("species", "rank", *CELLS, (F.col("c_re") / b).alias("c_re"), (F.col("c_im") / b).alias("c_im"))


@dataclass(frozen=True)
class Prepared:
    """What energy and gradients have in common, settled: coefficients per atom and rank, and the half spectrum of their density."""

    c6: DataFrame
    spectral: DataFrame


def prepared(model: Model) -> Prepared:
    c6 = settled(atom_coefficients(model), "c6")
    return Prepared(c6, settled(spectrum(model, density(model, c6)), "spectrum"))


def _met(model: Model, spectral: DataFrame) -> tuple[DataFrame, dict[str, Relation]]:
    """The spectrum with wave vectors, and what a kernel reads there: its species, its rank, and the spectrum of every species."""
    waves = spectral.withColumns(dict(zip(WAVES, wave_vector(model))))
    others = spectral.join(model.species.select("species", "sqrt_qz"), "species").drop("species")
    return waves, {"own": Relation(model.species, ("species",)), "rank": Relation(model.eigs, ("rank",)), "other": Relation(others, ("rank", *CELLS), many=True)}


def _interaction(model: Model, aux: dict[str, Relation], kernel: Callable[[Column, Column, Damping], Column]) -> Complex:
    """The other species' spectrum times the kernel of both and the rank's eigenvalue."""
    other = aux["other"]
    return Complex(other["c_re"], other["c_im"]).scale(kernel(F.col("k"), aux["own"]["sqrt_qz"] * other["sqrt_qz"], model.damping) * aux["rank"]["eig"])


def spectral_total(model: Model, spectral: DataFrame) -> DataFrame:
    """One row, ``total``: the weighted sum over the half spectrum."""
    waves, aux = _met(model, spectral)
    fn = lambda i, v, aux: (None, {"total": v["c"].conjugate() * _interaction(model, aux, reciprocal_kernel)})
    sums = map_spectrum(fn, waves, model.grid_shape, ["c"], BATCH, True, aux)[1]
    return sums.select(F.coalesce("total_re", F.lit(0.0)).alias("total"))


def _energy(model: Model, total: DataFrame, c6: DataFrame) -> DataFrame:
    both = total.select("total").join(self_energy(c6, model.eigs, model.selfcont))
    return both.select((F.col("total") / (-2 * model.volume) + F.col("vself") / 2).alias("energy"), "total", "vself")


def dispersion_energy(model: Model, strain: Matrix | None = None) -> DataFrame:
    """One row: ``energy``, ``total`` and ``vself``.  The strain acts on positions and lattice as v (1 + strain)^T."""
    if strain is not None:
        model = model.strained(strain)
    c6 = settled(atom_coefficients(model), "c6")
    return _energy(model, spectral_total(model, spectrum(model, density(model, c6))), c6)


def spectral_field(model: Model, spectral: DataFrame) -> DataFrame:
    """``(species, rank, ix, iy, iz, p_re, p_im, s_re, s_im)``: what all species do to one at a frequency, by the kernel and by its slope, from one pass over the pairs."""
    waves, aux = _met(model, spectral)
    fn = lambda i, v, aux: ({"p": _interaction(model, aux, reciprocal_kernel), "s": _interaction(model, aux, reciprocal_kernel_slope)}, None)
    return map_spectrum(fn, waves, model.grid_shape, ["c"], BATCH, True, aux)[0]


def potential(model: Model, field: DataFrame) -> DataFrame:
    """``(species, rank, ix, iy, iz, value)``: derivative of the energy's mesh part by the density."""
    scale = F.lit(-model.spacing / model.volume) / deconvolution(model)
    per = field.select("species", "rank", *CELLS, (F.col("p_re") * scale).alias("p_re"), (F.col("p_im") * scale).alias("p_im"))
    back = inverse_dft(per, model.grid_shape, ["p"], keys=BATCH, half=True)
    return back.select("species", "rank", *CELLS, F.col("p_re").alias("value"))


def spectral_sums(model: Model, spectral: DataFrame, field: DataFrame) -> DataFrame:
    """One row: ``total``, and how it changes with the wave vectors, ``m00`` to ``m22``."""
    own = Relation(spectral, (*BATCH, *CELLS))

    def fn(i, v):
        c = Complex(own["c_re"], own["c_im"]).conjugate()
        bend = (c * v["s"]).scale(1 / F.col("k"))
        return None, {"total": c * v["p"]} | {f"m{i}{j}": bend.scale(F.col(WAVES[i]) * F.col(WAVES[j])) for i in range(3) for j in range(3)}

    waves = field.withColumns(dict(zip(WAVES, wave_vector(model))))
    sums = map_spectrum(fn, waves, model.grid_shape, ["p", "s"], BATCH, True)[1]
    return sums.select(*(F.coalesce(c, F.lit(0.0)).alias(c.removesuffix("_re")) for c in sums.columns))


def energy_gradients(model: Model, ready: Prepared | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gradients of the energy without strain: ``(atom_id, gx, gy, gz)``, and ``(row, col, g)`` by the strain; and ``spectral_sums``."""
    spline, inv = bspline(model.order), inverse(model.lattice)
    ready = ready or prepared(model)
    c6 = ready.c6
    field = settled(spectral_field(model, ready.spectral), "field")
    sums = spectral_sums(model, ready.spectral, field)
    grids = {"phi": (potential(model, field), BATCH)}
    points = weighted_points(model, c6, slopes=True)
    phi = lambda s: s.grid["phi"]
    kernel = lambda s: {
        "value": phi(s) * s.pick(("wx", "wy", "wz")),
        "ux": phi(s) * s.pick(("dx", "wy", "wz")), "uy": phi(s) * s.pick(("wx", "dy", "wz")), "uz": phi(s) * s.pick(("wx", "wy", "dz")),
    }
    at_atoms = gather_from_mesh(points, spline.offsets, kernel, model.grid_shape, grids=grids, point_key=("atom_id", "species", "rank", "c6", "slope"))
    full = at_atoms.join(model.eigs, "rank").join(model.selfcont, ["species", "rank"])
    by_c6 = F.col("value") + F.col("eig") * F.col("c6") * F.col("s")
    per_atom = full.groupBy("atom_id").agg(F.sum(by_c6 * F.col("slope")).alias("by_cn"), *(F.sum(F.col(f"u{a}") * F.col("c6")).alias(f"u{a}") for a in "xyz"))
    mesh = [sum((F.col(f"u{c}") * F.lit(inv[a][b] * model.grid_shape[b]) for b, c in ((1, "y"), (2, "z"))), F.col("ux") * F.lit(inv[a][0] * model.grid_shape[0])) for a in range(3)]

    edges = edge_geometry(model.atoms, model.edges, model.lattice).join(per_atom.select(F.col("atom_id").alias("src"), "by_cn"), "src")
    pull = F.col("by_cn") * switching_slope(F.col("rc"), F.col("d"), model.r_cut) / F.col("d")
    edges = edges.select("src", "dst", "dx", "dy", "dz", pull.alias("pull"))
    ends = F.array(*[F.struct(F.col(end).alias("atom_id"), F.lit(sign).alias("sign")) for end, sign in (("dst", 1.0), ("src", -1.0))])
    ended = edges.select("dx", "dy", "dz", "pull", F.explode(ends).alias("e"))
    forces = ended.groupBy("e.atom_id").agg(*(F.sum(F.col("e.sign") * F.col("pull") * F.col(f"d{a}")).alias(f"f{a}") for a in "xyz"))
    by_position = per_atom.select("atom_id", *(m.alias(f"g{a}") for m, a in zip(mesh, "xyz"))).join(forces, "atom_id", "left")
    by_position = by_position.select("atom_id", *((F.col(f"g{a}") + F.coalesce(f"f{a}", F.lit(0.0))).alias(f"g{a}") for a in "xyz"))

    index = [(i, j) for i in range(3) for j in range(3)]
    from_edges = edges.agg(F.array(*[F.coalesce(F.sum(F.col("pull") * F.col(f"d{'xyz'[i]}") * F.col(f"d{'xyz'[j]}")), F.lit(0.0)) for i, j in index]).alias("edge"))
    one = sums.join(from_edges)
    mesh_part = lambda i, j: F.col(f"m{i}{j}") + F.col("total") if i == j else F.col(f"m{i}{j}")
    rows = F.array(*[F.struct(F.lit(i).alias("row"), F.lit(j).alias("col"), (F.get("edge", F.lit(n)) + mesh_part(i, j) / (2 * model.volume)).alias("g")) for n, (i, j) in enumerate(index)])
    return by_position, one.select(F.explode(rows).alias("r")).select("r.*"), sums


def dispersion_energy_and_derivatives(model: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Energy, gradient by positions, gradient by strain -- in this order.  Forces are the negative of the second.

    All three come from one set of coefficients, one spectrum and one pass over
    the pairs of species.
    """
    ready = prepared(model)
    by_position, by_strain, sums = energy_gradients(model, ready)
    return _energy(model, sums, ready.c6), by_position, by_strain
