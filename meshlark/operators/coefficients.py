"""Environment-dependent coefficients: lookup join, softmax over references, weighted sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reference_weights(cn: DataFrame, atoms: DataFrame, references: DataFrame) -> DataFrame:
    """``(atom_id, species, ref, weight, slope)``: softmax of -4 (cn - cnref)^2 over an atom's valid references.

    A reference of -1 is absent.  ``slope`` is the weight's derivative with
    respect to cn.  References are gathered per species first -- a handful each
    -- so the softmax needs no shuffle by atom.
    """
    valid = references.where("cnref <> -1.0").groupBy("species").agg(F.array_sort(F.collect_list(F.struct("ref", "cnref"))).alias("refs"))
    rows = atoms.select("atom_id", "species").join(cn.select("atom_id", "cn"), "atom_id").join(valid, "species", "left")
    known = F.when(F.col("refs").isNotNull(), F.col("refs")).otherwise(F.raise_error(F.lit("a species has no valid reference")))
    logits = F.transform(known, lambda r: F.lit(-4.0) * (F.col("cn") - r["cnref"]) * (F.col("cn") - r["cnref"]))
    rows = rows.select("atom_id", "species", "cn", known.alias("refs"), logits.alias("logits"))
    rows = rows.withColumn("e", F.transform("logits", lambda x: F.exp(x - F.array_max("logits"))))
    rows = rows.withColumn("total", F.aggregate("e", F.lit(0.0), lambda s, x: s + x)).withColumn("w", F.transform("e", lambda x: x / F.col("total")))
    rows = rows.withColumn("g", F.transform("refs", lambda r: F.lit(-8.0) * (F.col("cn") - r["cnref"])))
    rows = rows.withColumn("mean", F.aggregate(F.zip_with("w", "g", lambda w, g: w * g), F.lit(0.0), lambda s, x: s + x))
    out = rows.select("atom_id", "species", F.posexplode("refs").alias("at", "r"), "w", "g", "mean")
    w = F.get("w", F.col("at"))
    return out.select("atom_id", "species", F.col("r.ref").alias("ref"), w.alias("weight"), (w * (F.get("g", F.col("at")) - F.col("mean"))).alias("slope"))


def coefficients(weights: DataFrame, v_q: DataFrame) -> DataFrame:
    """``(atom_id, species, rank, c6, slope)``: weighted sums of the reference values, and their derivatives by cn."""
    return weights.join(v_q, ["species", "ref"]).groupBy("atom_id", "species", "rank").agg(F.sum(F.col("weight") * F.col("v")).alias("c6"), F.sum(F.col("slope") * F.col("v")).alias("slope"))


def self_energy(c6: DataFrame, eigs: DataFrame, selfcont: DataFrame) -> DataFrame:
    """One row, ``vself``: sum of eig c6^2 s over atoms and ranks."""
    return c6.join(selfcont, ["species", "rank"]).join(eigs, "rank").agg(F.coalesce(F.sum(F.col("eig") * F.col("c6") * F.col("c6") * F.col("s")), F.lit(0.0)).alias("vself"))
