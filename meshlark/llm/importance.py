"""Importance resampling towards a target distribution.

Documents are drawn so that their word n-grams look like those of a target
table.  Runs of 1 to 3 words are hashed into buckets; a bucket's gain is the log
of how much more often the target holds it than the corpus, and a document's
weight is the sum of gains over its runs.  Adding Gumbel noise to weights and
taking the highest scores draws without replacement.

Identical texts are collapsed first, by grouping full texts: their features are
hashed once and counted as often as the text occurs, their weight is computed
once and joined back to the documents, of which each then gets noise of its own.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of

BUCKETS = 10_000
LONGEST_RUN = 3
SEED = 42
#: Documents of fewer words are never drawn; of the others so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 4_000_000

#: A-Z lower-cased; every ASCII byte that is no letter or digit becomes a blank.
_WORDS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def _byte_step(crc: np.ndarray) -> np.ndarray:
    """CRC-32 registers after one more byte of zeros."""
    for _ in range(8):
        crc = np.where(crc & 1, crc >> 1 ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


def _compose(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """``outer`` after ``inner``: both are tables of what each of four bytes adds to a register."""
    return outer[0][inner & 255] ^ outer[1][inner >> 8 & 255] ^ outer[2][inner >> 16 & 255] ^ outer[3][inner >> 24]


class Shifts:
    """What a CRC-32 becomes when ``n`` more bytes follow: linear in its bits, so a table of four times 256 entries for each ``n``."""

    def __init__(self):
        self.powers = [_byte_step(np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None])]
        self.short = [self.of(n) for n in range(65)]

    def of(self, n: int) -> np.ndarray:
        out, bit = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None], 0
        while n >> bit:
            if bit == len(self.powers):
                self.powers.append(_compose(self.powers[-1], self.powers[-1]))
            if n >> bit & 1:
                out = _compose(self.powers[bit], out)
            bit += 1
        return out

    def tables(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One table for each different length, flat, and where in it each length's begins."""
        each, at = np.unique(lengths, return_inverse=True)
        made = [self.short[n] if n < len(self.short) else self.of(int(n)) for n in each]
        return np.concatenate([x.ravel() for x in made]), (at * 1024).astype(np.int32)


def _joined(left: np.ndarray, right: np.ndarray, table: np.ndarray, base: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings put together, from their own; ``base`` finds the shift by the second one's length."""
    out = right.copy()
    for k in range(4):
        out ^= table[base + (left >> np.uint32(8 * k) & np.uint32(255)).astype(np.int32) + 256 * k]
    return out


def hashed_runs(texts: list[bytes], shifts: Shifts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the number of words and of runs, and the buckets of all runs, text after text."""
    words = [t.translate(_WORDS).split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    if not n_words.sum():
        return n_words, n_words, np.empty(0, np.uint16)
    number: dict[bytes, int] = defaultdict(count().__next__)
    codes = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int32, n_words.sum())
    alone = np.fromiter(map(zlib.crc32, number), np.uint32, len(number))
    after = np.fromiter((zlib.crc32(b" " + w) for w in number), np.uint32, len(number))
    table, base = shifts.tables(np.fromiter(map(len, number), np.int64, len(number)) + 1)
    left = np.repeat(np.cumsum(n_words), n_words) - np.arange(len(codes))  # words from here to the text's end
    buckets = np.empty((len(codes), LONGEST_RUN), np.uint16)
    crc = alone[codes]
    buckets[:, 0] = crc % BUCKETS
    for more in range(1, LONGEST_RUN):
        ends = codes[more:]
        crc = _joined(crc[: len(ends)], after[ends], table, base[ends])
        buckets[: len(ends), more] = crc % BUCKETS
    n_runs = sum(np.maximum(n_words - more, 0) for more in range(LONGEST_RUN))
    return n_words, n_runs, buckets[np.arange(LONGEST_RUN) < left[:, None]]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shifts = Shifts()

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        digest, copies, texts = zip(*rows)
        n_words, n_runs, buckets = hashed_runs(list(texts), shifts)
        ends = pa.py_buffer(np.cumsum([0, *(2 * n_runs)]).astype("<i4"))
        runs = pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(buckets.astype("<u2", copy=False))])
        columns = [pa.array(digest, pa.binary()), pa.array(copies, pa.int64()), pa.array(n_words), pa.array(n_runs), runs]
        return pa.RecordBatch.from_arrays(columns, ["digest", "copies", "n_words", "n_features", "runs"])

    rows, held = [], 0
    for batch in batches:
        for digest, copies, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            raw = text.as_buffer().to_pybytes()
            if rows and held + len(raw) > CHUNK:
                yield flush(rows)
                rows, held = [], 0
            rows.append((digest, copies, raw))
            held += len(raw)
    if rows:
        yield flush(rows)


FEATURES = "digest binary, copies bigint, n_words bigint, n_features bigint, runs binary"


def text_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per distinct text: its SHA-256, how often it occurs, and its hashed runs as unsigned 16-bit numbers."""
    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select(_digest(F.col("text")).alias("digest"), "copies", "text").mapInArrow(_features, FEATURES)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def bucket_counts(features: DataFrame) -> np.ndarray:
    """How often each bucket occurs, copies counted.  Tasks send one row per bucket and batch of texts."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for copies, runs in zip(batch.column(0).to_pylist(), batch.column(1)):
                total += copies * np.bincount(np.frombuffer(runs.as_buffer(), "<u2"), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = features.select("copies", "runs").mapInArrow(tally, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counted.collect():  # at most one row per bucket
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed frequencies, floored."""
    all_s, all_t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * all_s / ((s + 1) * all_t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def text_weights(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """``(digest, n_words, n_features, weight)`` per distinct text."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gains[np.frombuffer(x.as_buffer(), "<u2")].sum()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["digest", "n_words", "n_features", "weight"])

    return features.select("digest", "n_words", "n_features", "runs").mapInArrow(weigh, "digest binary, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc: Column, seed: int = SEED) -> Column:
    """A document's own noise in thousandths: Gumbel distributed, from a digest of its id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, share: int) -> DataFrame:
    """Numbers the highest ``share`` percent of eligible rows of ``(doc, n_features, weight, score, eligible)`` from 1.

    Rows are dealt out by ranges of their place in the order, so a partition's
    first number is the count of those before it, and only partitions that reach
    into the drawn share are sorted.
    """
    spark = rows.sparkSession
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc").asc_nulls_last()]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "scored")
    parts = dealt.groupBy("part").agg(F.count_if("eligible").alias("n")).orderBy("part").collect()  # one row per partition
    drawn, begin, before = share * sum(p.n for p in parts) // 100, {}, 0
    for p in parts:
        if before < drawn:
            begin[p.part] = before
        before += p.n
    last = max(begin, default=-1)
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    first = F.create_map(*(F.lit(x) for p in begin.items() for x in p))[F.col("part")] if begin else F.lit(0)
    top = dealt.where(F.col("part") <= last).withColumn("number", (place + first).cast("bigint"))
    top = top.withColumn("rank", F.when(F.col("number") <= drawn, F.col("number"))).drop("number")
    return top.unionByName(dealt.where(F.col("part") > last).withColumn("rank", F.lit(None).cast("bigint"))).drop("part", "eligible")


def importance_sample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """Draw ``percent`` of the documents with ``least_words`` words or more, so that their runs of words follow ``target``.

    One row per row of ``docs``: ``id_col``, ``n_features``, ``weight``,
    ``score`` and ``rank``, 1 for the highest score; null for what is not drawn.

    A null text is an empty one and has no words, no features and weight 0.
    Texts may be of any length; each is hashed whole, in one task.  Rows repeated
    with one id have the same noise and are drawn each; rows without an id share
    the noise of an empty id and come last among ties.  An empty ``docs`` gives
    no rows, an empty ``target`` counts nothing.  Other columns are ignored,
    whatever their names.
    """
    base = text_of(docs, id_col, text_col).select("doc", _digest(F.col("text")).alias("digest"))
    features = materialize(text_features(docs, text_col), "features")
    gains = bucket_gains(bucket_counts(features), bucket_counts(text_features(target, target_col)))
    weights = text_weights(features, gains)
    rows = base.join(weights.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"))
    rows = rows.select("doc", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    return ranked(rows, percent).withColumnRenamed("doc", id_col)
