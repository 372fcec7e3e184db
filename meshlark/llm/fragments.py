"""Rows of hashes that occur in documents, packed by fragment of the hash order.

A packed row holds, for one fragment, every hash once, with its document if
only one had it (``alone``), and lists ``(hash, document)`` for hashes that are
known to be shared.  Rows of one fragment can be merged again and again: a hash
comes once a row, so however common it is, a task meets it once per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import signed

NAMES = ["fragment", "tokens", "docs", "alone", "shared_tokens", "shared_docs"]
PACKED = "fragment int, tokens array<bigint>, docs array<bigint>, alone array<boolean>, shared_tokens array<bigint>, shared_docs array<bigint>"


def fragments_for(rows: int, each: int, least: int) -> int:
    """A power of two of fragments, at least ``least``, that hold about ``each`` rows at most."""
    return 1 << max(least - 1, -(-rows // each) - 1, 1).bit_length()


def fragment_of(tokens: np.ndarray, fragments: int) -> np.ndarray:
    """The fragment of unsigned hashes: their first bits, as there is a power of two of fragments."""
    return (tokens >> np.uint64(65 - fragments.bit_length())).astype("i8") if fragments > 1 else np.zeros(len(tokens), "i8")


def _cut(tokens: np.ndarray, fragments: int) -> np.ndarray:
    """Bounds of the fragments in sorted hashes."""
    return np.searchsorted(fragment_of(tokens, fragments), np.arange(fragments + 1)).astype("i4")


def as_lists(bounds: np.ndarray, *columns: np.ndarray) -> list[pa.ListArray]:
    return [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in columns]


def pack(tokens: np.ndarray, docs: np.ndarray, fragments: int) -> pa.RecordBatch:
    """Packed rows of pairs of an unsigned hash and a document."""
    order = np.argsort(tokens, kind="stable")
    tokens, docs = tokens[order], docs[order]
    first = np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)]
    alone = first & np.append(first[1:], True)[: len(first)]
    shared = ~alone
    own = as_lists(_cut(tokens[first], fragments), signed(tokens[first]), np.where(alone, docs, 0)[first], alone[first])
    more = as_lists(_cut(tokens[shared], fragments), signed(tokens[shared]), docs[shared])
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(fragments, dtype="i4")), *own, *more], NAMES)
    return rows.filter(pa.array(np.diff(own[0].offsets.to_numpy()) + np.diff(more[0].offsets.to_numpy()) > 0))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the rows of each fragment, which come one after another; lists of shared hashes pass through."""
    fragment, held = None, []

    def row(f: int, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), *(as_lists(np.array([0, len(x)], "i4"), x)[0] for x in columns)], NAMES)

    def flush() -> pa.RecordBatch:
        tokens, docs, alone = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(tokens.view("u8"), kind="stable")
        tokens, docs, alone = tokens[order], docs[order], alone[order]
        first = np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)]
        single = first & np.append(first[1:], True)[: len(first)]
        more = ~single & alone
        keep_alone = (alone & single)[first]
        return row(fragment, tokens[first], np.where(keep_alone, docs[first], 0), keep_alone, tokens[more], docs[more])

    for batch in batches:
        for i, f in enumerate(batch.column(0).to_pylist()):
            if f != fragment and held:
                yield flush()
                held = []
            fragment = f
            tokens, docs, alone, s_tokens, s_docs = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(1, 6))
            held.append((tokens, docs, alone.astype(bool)))
            if len(s_tokens):
                yield row(f, tokens[:0], docs[:0], alone[:0].astype(bool), s_tokens, s_docs)
    if held:
        yield flush()


def merged(rows: DataFrame, parts: int) -> DataFrame:
    """Packed rows merged to one per fragment, besides those that pass shared hashes through."""
    return rows.repartition(parts, "fragment").sortWithinPartitions("fragment").mapInArrow(_merge, PACKED)


def recut(rows: DataFrame, fragments: int) -> DataFrame:
    """Packed rows, cut into other fragments than they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, docs, alone, s_tokens, s_docs = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(1, 6))
                order = np.argsort(s_tokens.view("u8"), kind="stable")
                own = as_lists(_cut(tokens.view("u8"), fragments), tokens, docs, alone.astype(bool))
                more = as_lists(_cut(s_tokens.view("u8")[order], fragments), s_tokens[order], s_docs[order])
                out = pa.RecordBatch.from_arrays([pa.array(np.arange(fragments, dtype="i4")), *own, *more], NAMES)
                yield out.filter(pa.array(np.diff(own[0].offsets.to_numpy()) + np.diff(more[0].offsets.to_numpy()) > 0))

    return rows.mapInArrow(run, PACKED)


def shared(rows: DataFrame) -> DataFrame:
    """``(token, doc)`` of hashes that two documents have, or one has twice."""
    pairs = rows.where(F.size("shared_tokens") > 0).select(F.explode(F.arrays_zip("shared_tokens", "shared_docs")).alias("s"))
    return pairs.select(F.col("s.shared_tokens").alias("token"), F.col("s.shared_docs").alias("doc"))
