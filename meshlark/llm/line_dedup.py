"""Line deduplication with two Bloom filters, for hashes seen once and seen twice.

Eight-byte hashes of the lines are dealt to shards of bounded size.  A shard
streams its hashes past two filters; a hash that meets both is at its third
sighting and becomes a suspect.  Line texts move only if suspected: they are
counted exactly, and the document that keeps a line is chosen from all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, other_id, text_of

BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: Hashes a shard is made for: its two filters take 4 MB, whatever the corpus.
SHARD = 1_000_000
BITS_PER_HASH, PROBES = 16, 4


class Bloom:
    """A Bloom filter over 64-bit hashes."""

    def __init__(self, capacity: int):
        self.bits = max(10, (capacity * BITS_PER_HASH - 1).bit_length())
        self.words = np.zeros(1 << (self.bits - 6), "u8")

    def _places(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = (hashes * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for i in range(PROBES):
            place = (hashes + np.uint64(i) * step) >> np.uint64(64 - self.bits)
            yield (place >> np.uint64(6)).astype("i8"), np.uint64(1) << (place & np.uint64(63))

    def add(self, hashes: np.ndarray) -> None:
        for word, bit in self._places(hashes):
            np.bitwise_or.at(self.words, word, bit)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for word, bit in self._places(hashes):
            found &= (self.words[word] & bit) != 0
        return found


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """A line's key, or None if it is too short to count.  ``bytes.lower`` lowers A-Z only."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return key


def _keys(text: str, min_chars: int) -> set[bytes]:
    found = {line_key(x, min_chars) for x in text.encode("utf-8", "surrogatepass").split(b"\n")}
    found.discard(None)
    return found


def _hash(key: bytes) -> int:
    h = xxhash.xxh64_intdigest(key)
    return h - (1 << 64) if h >> 63 else h


def _line_hashes(min_chars: int):
    """Distinct line hashes per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes = [list({_hash(k) for k in _keys(t.as_py(), min_chars)}) for t in part.column(1)]
                docs = np.repeat(np.arange(part.num_rows), [len(x) for x in hashes])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(docs)), part.column(2).take(pa.array(docs)), pa.array([h for x in hashes for h in x], pa.int64())], ["doc", "alt", "hash"])

    return run


def _sightings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts a batch's equal hashes before they move; three are as good as more."""
    for batch in batches:
        hashes, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.minimum(n, 127).astype("i1"))], ["hash", "n"])


def _suspects(capacity: int, least: int):
    """Hashes at their third sighting (or the second or first, if ``least`` is less), by two filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(capacity), Bloom(capacity)
        for batch in batches:
            hashes, at = np.unique(batch.column(0).to_numpy().view("u8"), return_inverse=True)
            n = np.bincount(at, weights=batch.column(1).to_numpy(), minlength=len(hashes)).astype("i8")
            n += once.has(hashes).astype("i8")
            n += twice.has(hashes)
            once.add(hashes)
            twice.add(hashes[n >= 2])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[n >= min(least, 3)].view("i8"))], ["hash"])

    return run


def _suspected_lines(min_chars: int):
    """A document's distinct lines whose hashes are suspects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, keys = [], []
                for i, (text, hashes) in enumerate(zip(part.column(1), part.column(3))):
                    wanted = set(hashes.as_py())
                    own = [k for k in _keys(text.as_py(), min_chars) if _hash(k) in wanted]
                    rows += [i] * len(own)
                    keys += own
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), part.column(2).take(pa.array(rows, pa.int64())), pa.array(keys, pa.binary())], ["doc", "alt", "key"])

    return run


def _drop_lines(min_chars: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n_lines, n_dropped, digest, kept = [], [], [], []
                for text, keys in zip(part.column(1), part.column(2)):
                    raw = text.as_py().encode("utf-8", "surrogatepass")
                    lines, gone = raw.split(b"\n"), set(keys.as_py() or ())
                    stay = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                    out = b"\n".join(stay)
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                    digest.append(hashlib.sha256(out).hexdigest())
                    kept.append(out.decode("utf-8", "surrogatepass") if with_text else None)
                columns = [part.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string()), *part.columns[3:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "n_lines", "n_dropped", "kept_sha256", "kept_text", *part.schema.names[3:]])

    return run


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, with_text: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Drop lines found in ``min_docs`` documents or more, except in the one with the largest id.

    A line's key is the line without blanks at its ends and with A-Z
    lower-cased; keys of fewer than ``min_chars`` code points always stay.
    Returns one row per input row: ``id_col``, ``n_lines``, ``n_dropped``,
    ``kept_sha256``, if ``with_text``, ``kept_text``, and the columns ``carry``.

    A null or empty text is one empty line.  A line repeated in a document
    counts once and stays or goes as a whole.  Rows repeated with one id are
    one document, and keep a line together.  A row without an id counts for no
    document and keeps no line that others keep.  Texts and lines may be of any
    length that fits a row.  An empty table gives an empty result; other
    columns are ignored.
    """
    base = text_of(docs, id_col, text_col)
    kind = base.schema["doc"].dataType.simpleString()
    # Rows without an id are told apart by their texts, so that they don't gather in one group.
    base = base.withColumn("alt", other_id()).select("doc", "text", "alt")
    pairs = materialize(base.mapInArrow(_line_hashes(min_chars), f"doc {kind}, alt bigint, hash bigint"), "line-hashes")
    total = pairs.count()
    shards = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    # Hashes are dealt evenly, and equal ones of a batch move as one row.
    sightings = pairs.select("hash").mapInArrow(_sightings, "hash bigint, n tinyint").repartition(shards, "hash")
    suspects = sightings.mapInArrow(_suspects(max(1024, total // shards), min_docs), "hash bigint").distinct()
    wanted = pairs.join(suspects, "hash", "left_semi").groupBy(F.col("doc").alias("w_doc"), F.col("alt").alias("w_alt")).agg(F.collect_set("hash").alias("hashes"))

    # The texts are dealt out by id once; both joins read the same exchange.
    own = lambda side: F.col("doc").eqNullSafe(F.col(f"{side}_doc")) & F.col("alt").eqNullSafe(F.col(f"{side}_alt"))
    lines = base.join(wanted, own("w")).select("doc", "text", "alt", "hashes").mapInArrow(_suspected_lines(min_chars), f"doc {kind}, alt bigint, key binary")
    repeated = lines.groupBy("key").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("keeper")).where(F.col("docs") >= min_docs).select("key", "keeper")
    # A line may be in a third of all documents; adaptive execution splits its side of the join.
    drops = (
        lines.join(repeated, "key")
        .where(F.col("doc").isNull() | (F.col("doc") < F.col("keeper")))
        .groupBy(F.col("doc").alias("d_doc"), F.col("alt").alias("d_alt"))
        .agg(F.collect_set("key").alias("keys"))
    )
    schema = f"doc {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string, kept_text string"
    whole, rest = base, []
    if carry:
        row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
        whole, rest = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row).withColumn("alt", other_id()), ["row"]
        schema += f", row {whole.schema['row'].dataType.simpleString()}"
    judged = whole.join(drops, own("d"), "left").select("doc", "text", "keys", *rest)
    out = judged.mapInArrow(_drop_lines(min_chars, with_text), schema)
    kept = ["kept_text"] if with_text else []
    return out.select(F.col("doc").alias(id_col), "n_lines", "n_dropped", "kept_sha256", *kept, *([f"row.{c}" for c in carry]))
