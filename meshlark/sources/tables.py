"""A particle system out of general tables: atoms from vectors, directed edges from order lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kernel import Damping
from ..plans.model import Model
from .storage import small_table

N_SPECIES, N_REFERENCES, N_RANKS = 3, 3, 2
LATTICE = ((20.0, 0.8, 0.4), (2.2, 18.0, 0.6), (1.4, -1.6, 22.0))
GRID, ORDER, R_CUT = (8, 8, 8), 4, 6.0
DAMPING = Damping(1.0, 0.7875, 0.4289, 4.4407)
STRETCH, SIDE = 37, 20.0
EIGS = [0.4, 0.25]
REFERENCES = [(z, p, -1.0 if (z, p) == (2, 2) else 0.5 + 1.1 * p + 0.3 * z) for z in range(N_SPECIES) for p in range(N_REFERENCES)]
V_Q = [(z, p, r, math.sin(1 + 3 * z + 2 * p + r)) for z in range(N_SPECIES) for p in range(N_REFERENCES) for r in range(N_RANKS)]
SELFCONT = [(z, r, 0.3 + 0.1 * z + 0.05 * r) for z in range(N_SPECIES) for r in range(N_RANKS)]
SQRT_QZ = [(z, 0.6 + 0.1 * z) for z in range(N_SPECIES)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An atom per vector: its species from the label, its place from the first three elements."""
    place = [SIDE * (STRETCH * F.col("embedding")[i].cast("double") - F.floor(STRETCH * F.col("embedding")[i].cast("double"))) for i in range(3)]
    species = (F.col("label") % N_SPECIES).cast("int")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("atom_id"), species.alias("species"), (F.lit(0.6) + F.lit(0.15) * species).alias("rcov"), *(c.alias(a) for c, a in zip(place, "xyz")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge per order line between atoms chosen by its keys; lines that would be an edge of no length are none."""
    n = F.broadcast(read(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n")))  # one row
    step = lambda c: (c % 3 - 1).cast("int")
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").join(n)
    out = lines.select((o % F.col("n")).alias("src"), (p % F.col("n")).alias("dst"), step(F.col("l_linenumber")).alias("sx"), step(F.col("l_suppkey")).alias("sy"), step(o + p).alias("sz"))
    return out.where("src <> dst OR sx <> 0 OR sy <> 0 OR sz <> 0")


def model(spark: SparkSession, sf_dir: str) -> Model:
    return Model(
        atoms(spark, sf_dir), edges(spark, sf_dir),
        small_table(spark, REFERENCES, "species int, ref int, cnref double"),
        small_table(spark, V_Q, "species int, ref int, rank int, v double"),
        small_table(spark, list(enumerate(EIGS)), "rank int, eig double"),
        small_table(spark, SELFCONT, "species int, rank int, s double"),
        small_table(spark, SQRT_QZ, "species int, sqrt_qz double"),
        LATTICE, DAMPING, R_CUT, GRID, ORDER,
    )
