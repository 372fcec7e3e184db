"""Clustering of integer vectors around centroids, exact to the last bit.

Components become integers, so every distance is a whole number and the nearest
centroid is defined without rounding.  A float32 matrix product gives each
distance within an interval that is proven to hold the true one; where the
lowest interval overlaps another, those centroids' distances are computed again
in 64-bit integers, and the lowest number among the nearest wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

COMPONENTS, SCALE = 64, 256
CENTROIDS, ROUNDS, SEED = 40, 5, 2
#: Larger quantised components would let a squared distance of 64 of them leave 64 bits.
LARGEST = 1 << 27
#: Vectors compared with the centroids at once.
BLOCK = 8192


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec, q)``: the vectors with all components finite, as integers ``floor(256 x)``."""
    x = F.col(vector_col)
    whole = (F.size(x) == COMPONENTS) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    q = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    fits = F.forall("q", lambda c: F.abs(c) <= LARGEST)
    kept = vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).alias("vec"), q.alias("q"))
    return kept.select("vec", F.when(fits, F.col("q").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST // SCALE}"))).alias("q"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the least digests of their ids, by digest; equal ones by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec").cast("string"), F.lit(""))), 256)
    rows = kept.select(digest.alias("digest"), "q").orderBy("digest", "q").limit(k).collect()  # k rows
    return np.array([r.q for r in rows], np.int64).reshape(len(rows), COMPONENTS)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid, the lowest of equals, and its squared distance.

    With ``u = 2**-24``, a float32 dot product of n rounded inputs is within
    ``g |x| |c|`` of the true one, ``g = (n+2) u / (1 - (n+2) u)``, in whatever
    order it is summed.  The distances below leave out ``|x|**2``, which all
    share; the intervals are widened a little more for their own arithmetic.
    """
    g = (COMPONENTS + 2) * 2.0**-24 / (1 - (COMPONENTS + 2) * 2.0**-24)
    c2 = np.einsum("ij,ij->i", centroids, centroids)
    x2 = np.einsum("ij,ij->i", x, x)
    dots = x.astype(np.float32) @ centroids.astype(np.float32).T
    screened = c2 - 2.0 * dots.astype(np.float64)
    off = 2 * g * (1 + 1e-9) * np.sqrt(x2.astype(np.float64))[:, None] * np.sqrt(c2.astype(np.float64)) + 2.0**-50 * (c2 + 2 * np.abs(dots))
    reach = (screened + off).min(axis=1)
    near = screened - off <= reach[:, None]
    best = near.argmax(axis=1)
    row, number = np.nonzero(near[near.sum(axis=1) > 1])
    doubtful = np.flatnonzero(near.sum(axis=1) > 1)
    if len(doubtful):
        exact = np.full((len(doubtful), len(centroids)), np.iinfo(np.int64).max)
        for begin in range(0, len(row), BLOCK):
            r, n = row[begin : begin + BLOCK], number[begin : begin + BLOCK]
            apart = x[doubtful[r]] - centroids[n]
            exact[r, n] = np.einsum("ij,ij->i", apart, apart)
        best[doubtful] = exact.argmin(axis=1)
    apart = x - centroids[best]
    return best.astype(np.int32), np.einsum("ij,ij->i", apart, apart)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            part = batch.slice(begin, BLOCK)
            yield part, part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS).astype(np.int64)


def _sums(centroids: np.ndarray) -> Callable:
    """Adds up each cluster within a task, which sends one row per centroid and component at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for _, x in _blocks(batches):
            best, _ = nearest(x, centroids)
            order = np.argsort(best, kind="stable")
            each, begin = np.unique(best[order], return_index=True)
            total[each] += np.add.reduceat(x[order], begin)
            n += np.bincount(best, minlength=len(n))
        cluster, place = np.divmod(np.arange(total.size), COMPONENTS)
        met = n[cluster] > 0
        columns = [cluster[met].astype(np.int32), place[met].astype(np.int32), total.ravel()[met], n[cluster][met]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "place", "total", "n"])

    return run


def _assign(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, nearest(x, centroids))], ["vec", "cluster", "distance"])

    return run


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid at the floored mean of its vectors; one without vectors stays."""
    sums = kept.select("q").mapInArrow(_sums(centroids), "cluster int, place int, total bigint, n bigint")
    sums = sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # at most one row per centroid and component
        out[r.cluster, r.place] = int(r.total) // r.n
    return out


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
) -> DataFrame:
    """Cluster the vectors of 64 finite components around ``k`` centroids.

    One row per kept vector: ``id_col``, ``cluster``, ``distance`` (squared, to
    its centroid, of components ``floor(256 x)``), ``cluster_inertia`` and
    ``inertia`` (sums of distances) and ``centroid_sha256`` (of the centroid's
    components, joined by commas).

    Vectors that are null, of another length, or hold a null or a non-finite
    component are left out; one with a component beyond 524,288 is an error, as
    distances would leave 64 bits.  Repeated ids are vectors of their own; a null
    id counts as an empty one for the choice of first centroids.  With fewer
    than ``k`` vectors each is a centroid; without any there are no rows.  Equal
    centroids are allowed, the later ones stay empty.  Other columns are
    ignored, whatever their names.
    """
    spark: SparkSession = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    kept = materialize(quantised(vectors, id_col, vector_col), "quantised")
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        none = kept.select("vec").withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("bigint"), "cluster_inertia": F.lit(0).cast("bigint"), "inertia": F.lit(0).cast("bigint"), "centroid_sha256": F.lit("")})
        return none.limit(0).withColumnRenamed("vec", id_col)
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    schema = f"vec {kind.simpleString()}, cluster int, distance bigint"
    found = materialize(kept.select("vec", "q").mapInArrow(_assign(centroids), schema), "assigned")
    inertia = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # k rows
    facts = {c: (n, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()}
    pick = lambda i: F.create_map(*(F.lit(v) for c, f in facts.items() for v in (c, f[i])))[F.col("cluster")] if facts else F.lit(None)
    return found.select(
        F.col("vec").alias(id_col), "cluster", "distance", pick(0).cast("bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), pick(1).cast("string").alias("centroid_sha256"),
    )
