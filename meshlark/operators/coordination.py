"""Coordination numbers: an edge aggregation over a neighbour list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import logistic

Matrix = Sequence[Sequence[float]]
IDENTITY = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))


def strained(vector: Sequence[Column], strain: Matrix | None, transposed: bool = False) -> list[Column]:
    """``v (1 + strain)``, or with the transpose of the strain."""
    if strain is None:
        return list(vector)
    entry = lambda a, b: strain[a][b] if transposed else strain[b][a]
    return [vector[a] + sum((vector[b] * F.lit(float(entry(a, b))) for b in range(1, 3)), vector[0] * F.lit(float(entry(a, 0)))) for a in range(3)]


def edge_geometry(atoms: DataFrame, edges: DataFrame, lattice: Matrix, strain: Matrix | None = None) -> DataFrame:
    """Edges with ``rc`` (sum of the covalent radii), displacement ``dx dy dz`` and distance ``d``.

    The join with the source atom is last, so that sums by source need no
    further shuffle.  Edges are neither deduplicated nor cut off by distance.
    An edge of length zero is an error.
    """
    side = lambda s: atoms.select(F.col("atom_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("rcov", "x", "y", "z")))
    both = edges.join(side("dst"), "dst").join(side("src"), "src")
    # Summed from left to right, as in SQL: another order would change last bits, and with them rounded results.
    plain = [sum((F.col(f"s{n}") * F.lit(float(lattice[i][a])) for i, n in enumerate("xyz")), F.col(f"{c}_dst") - F.col(f"{c}_src")) for a, c in enumerate("xyz")]
    dx, dy, dz = strained(plain, strain)
    out = both.select("src", "dst", "sx", "sy", "sz", (F.col("rcov_src") + F.col("rcov_dst")).alias("rc"), dx.alias("dx"), dy.alias("dy"), dz.alias("dz"))
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return out.withColumn("d", F.when(length > 0, length).otherwise(F.raise_error(F.lit("an edge has no length"))))


def steepness(rc: Column, d: Column, r_cut: float) -> Column:
    t = (rc + r_cut) / 2
    longer = F.greatest(d, t)
    return 16 + (longer - t) * (longer - t) / ((r_cut - longer) * (r_cut - longer) + 1e-6)


def switching(rc: Column, d: Column, r_cut: float) -> Column:
    """What an edge adds to its source's coordination number."""
    return logistic(steepness(rc, d, r_cut) * (F.lit(4.0 / 3.0) * rc / d - 1))


def switching_slope(rc: Column, d: Column, r_cut: float) -> Column:
    """Derivative of ``switching`` with respect to the distance."""
    t = (rc + r_cut) / 2
    longer, rest = F.greatest(d, t), F.lit(4.0 / 3.0) * rc
    q = (r_cut - longer) * (r_cut - longer) + 1e-6
    rise = F.when(d > t, (2 * (longer - t) * q + 2 * (longer - t) * (longer - t) * (r_cut - longer)) / (q * q)).otherwise(F.lit(0.0))
    c = switching(rc, d, r_cut)
    return c * (1 - c) * (rise * (rest / d - 1) - steepness(rc, d, r_cut) * rest / (d * d))


def coordination_numbers(atoms: DataFrame, edges: DataFrame, lattice: Matrix, r_cut: float, strain: Matrix | None = None) -> DataFrame:
    """``(atom_id, cn)`` for every atom; 0 without edges.  A strain acts on positions as ``x (1 + strain)``."""
    terms = edge_geometry(atoms, edges, lattice, strain).select("src", switching(F.col("rc"), F.col("d"), r_cut).alias("c"))
    sums = terms.groupBy("src").agg(F.sum("c").alias("c"))
    return atoms.select("atom_id").join(sums, F.col("atom_id") == F.col("src"), "left").select("atom_id", F.coalesce("c", F.lit(0.0)).alias("cn"))
