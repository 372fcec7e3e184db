"""Byte-level BPE, encoding and decoding.

A text is cut into pre-tokens.  Those that are tokens themselves are found by a
minimal perfect hash over the vocabulary: one displacement per bucket of keys
sends every token to a slot of its own, and the token there is compared byte by
byte.  The others are merged: their bytes form a linked list, a heap holds the
pairs that are tokens by rank and place, and the lowest is joined until none is
left, in n log n steps however long the pre-token is.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate, count, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .packing import Memo

#: Keys of a bucket of the perfect hash, on average, and displacements that are tried at once.
BUCKET, TRIES = 4, 1024
#: Characters whose distinct pre-tokens are looked up together, and ids that are returned together.
CHUNK, FLUSH = 1_000_000, 1_000_000

_MASK = (1 << 64) - 1


def _spread(h, d):
    """A place for hash ``h`` under displacement ``d``; both unsigned 64-bit arrays."""
    x = h + d * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class PerfectHash:
    """Sends each of the ``keys`` to its own number, with as many slots as keys."""

    def __init__(self, keys: list[bytes]):
        self.keys, n = keys, len(keys)
        self.buckets = max(1, n // BUCKET)
        self.shift, self.slot_key = np.zeros(self.buckets, np.int64), np.full(n, -1, np.int64)
        h = self.hashes(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        begin = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        size = np.diff(begin)
        taken = np.zeros(n, bool)
        for b in np.argsort(-size, kind="stable"):
            own = order[begin[b] : begin[b + 1]]
            if len(own) < 2:
                break
            self.shift[b], slots = self._fit(h[own], taken)
            taken[slots], self.slot_key[slots] = True, own
        free = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(size == 1):  # these take what is left; a negative displacement names the slot
            slot = next(free)
            self.shift[b], self.slot_key[slot] = -1 - slot, order[begin[b]]

    def _fit(self, h: np.ndarray, taken: np.ndarray) -> tuple[int, np.ndarray]:
        for first in range(0, 1 << 32, TRIES):
            slots = (_spread(h[:, None], np.arange(first, first + TRIES, dtype=np.uint64)) % np.uint64(len(taken))).astype(np.int64)
            good = ~taken[slots].any(axis=0)
            for at in np.flatnonzero(good):
                if len(set(slots[:, at].tolist())) == len(h):
                    return first + int(at), slots[:, at]
        raise ValueError("two keys are equal")

    @staticmethod
    def hashes(keys: Iterable[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)

    def find_all(self, keys: list[bytes]) -> np.ndarray:
        """The number of each key; -1 for one that is none of the set."""
        h = self.hashes(keys)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = (_spread(h, shift.astype(np.uint64)) % np.uint64(len(self.keys))).astype(np.int64)
        number = self.slot_key[np.where(shift < 0, -1 - shift, slot)]
        same = np.fromiter((self.keys[i] == k for i, k in zip(number.tolist(), keys)), bool, len(keys))
        return np.where(same, number, -1)

    def find(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        slot = int(self.shift[h % self.buckets])
        if slot < 0:
            slot = -1 - slot
        else:
            x = (h + slot * 0x9E3779B97F4A7C15) & _MASK
            x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & _MASK
            slot = (x ^ x >> 32) % len(self.keys)
        number = int(self.slot_key[slot])
        return number if self.keys[number] == key else -1


@functools.cache
def character_kinds() -> np.ndarray:
    """An ASCII stand-in for every character that is treated alike by the pattern; ASCII stands for itself."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    stand = np.full(0x110000, ord("!"), np.uint8)
    for kind, letter in ((r"\p{L}", "A"), (r"\p{N}", "0"), (r"\s", "\t")):
        for m in regex.finditer(kind + "+", every):
            stand[m.start() : m.end()] = ord(letter)
    stand[:128] = np.arange(128)
    return stand


#: The public pattern (a fixed value of the vocabulary) over stand-ins, and over ASCII texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
SHAPES, ASCII = re.compile(_PATTERN.encode()), re.compile(_PATTERN, re.ASCII)


def pre_tokens(text: str) -> list[str]:
    """What the pattern matches, one after another; together they are the text."""
    if text.isascii():
        return ASCII.findall(text)
    shape = character_kinds()[np.frombuffer(text.encode("utf-32-le"), "<u4")].tobytes()
    ends = list(accumulate(map(len, SHAPES.findall(shape))))
    return [text[a:b] for a, b in zip([0, *ends], ends)]


class ByteBPE:
    """A vocabulary of ranks, as the public rank files have it: a token and its rank on each line, from 0 without gaps."""

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as lines:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.tokens = [ranks[i] for i in range(len(ranks))]
        self.hash, self.longest = PerfectHash(self.tokens), max(map(len, self.tokens))
        self.bytes = self.hash.find_all([bytes([b]) for b in range(256)]).tolist()
        self.two = self.hash.find_all([bytes(p) for p in product(range(256), repeat=2)]).tolist()
        if min(self.bytes) < 0:
            raise ValueError("every byte must be a token")

    @functools.cached_property
    def rank(self) -> Memo:
        """Ranks of joined bytes, -1 for what is no token."""
        return Memo(self.hash.find)

    @functools.cached_property
    def misses(self) -> Memo:
        """Ids of pre-tokens that had to be merged."""
        return Memo(self.merge)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rank", "misses")}

    def merge(self, piece: bytes) -> bytes:
        """Ids of a pre-token that is no token, as native 32-bit integers."""
        rank, longest, n = self.rank, self.longest, len(piece)
        ids, after, before = [self.bytes[b] for b in piece], list(range(1, n + 2)), list(range(-1, n))
        two = self.two
        pair = [two[a << 8 | b] for a, b in zip(piece, piece[1:])]
        pair += (-1, -1)
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]  # by rank, then by place
        heapify(heap)
        while heap:
            r = heappop(heap)
            i, r = r & 0xFFFFFFFF, r >> 32
            if pair[i] != r:
                continue
            gone, left = after[i], before[i]
            ids[i], after[i], pair[gone], pair[i] = r, (end := after[gone]), -1, -1
            if end < n:
                before[end] = i
                stop = after[end]
                if stop - i <= longest and (new := rank[piece[i:stop]]) >= 0:
                    pair[i] = new
                    heappush(heap, new << 32 | i)
            if left >= 0:
                pair[left] = new = rank[piece[left:end]] if end - left <= longest else -1
                if new >= 0:
                    heappush(heap, new << 32 | left)
        out, i = array("i"), 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out.tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text: distinct pre-tokens are looked up in the perfect hash at once, then the misses merged."""
        pieces = [pre_tokens(t) for t in texts]
        number: dict[str, int] = defaultdict(count().__next__)
        codes = [list(map(number.__getitem__, p)) for p in pieces]
        raw = [p.encode() for p in number]
        whole = self.hash.find_all(raw)
        ids = [array("i", [i]).tobytes() if i >= 0 else self.misses[p] for i, p in zip(whole.tolist(), raw)]
        return [b"".join(map(ids.__getitem__, c)) for c in codes]

    @functools.cached_property
    def sizes(self) -> np.ndarray:
        """How many bytes each token has."""
        return np.fromiter(map(len, self.tokens), np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, put together."""
        n = self.sizes[ids]
        begin = (np.cumsum(self.sizes) - self.sizes)[ids]
        return self._spelling[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]

    @functools.cached_property
    def _spelling(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.tokens), np.uint8)


def _spelled(bpe: ByteBPE, flat: np.ndarray, ends: np.ndarray, valid: pa.Buffer | None = None) -> pa.Array:
    """What each row's ids spell; ``ends`` are the places in ``flat`` where rows end, from 0 on."""
    if len(flat) and not (0 <= flat.min() and flat.max() < len(bpe.tokens)):
        raise ValueError("an id is not in the vocabulary")
    at = np.concatenate([[0], np.cumsum(bpe.sizes[flat])])[ends]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [valid, pa.py_buffer(at.astype("<i4")), pa.py_buffer(bpe.decode(flat))])


def _encode(shared, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe: ByteBPE = shared.value

        def made(docs: list, ids: list[bytes]) -> pa.RecordBatch:
            ends, flat = np.cumsum([0, *(len(x) // 4 for x in ids)]), np.frombuffer(b"".join(ids), "i4")
            columns = {"doc": pa.concat_arrays(docs), "ids": pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(flat))}
            if with_bytes:
                columns["bytes"] = _spelled(bpe, flat, ends)
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        docs, ids, texts, held, size = [], [], [], 0, 0
        for batch in batches:
            for row, text in enumerate(batch.column(1)):
                docs.append(batch.column(0).slice(row, 1))
                texts.append(text.as_py())
                held += len(texts[-1])
                if held > CHUNK:
                    ids += bpe.encode_all(texts)
                    size += sum(len(x) // 4 for x in ids[-len(texts) :])
                    texts, held = [], 0
                    if size > FLUSH:
                        yield made(docs, ids)
                        docs, ids, size = [], [], 0
        if docs:
            yield made(docs, ids + bpe.encode_all(texts))

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe: ByteBPE = shared.value
        for batch in batches:
            lists, row = batch.column(1), 0
            ends = np.concatenate([[0], lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()])
            while row < len(lists):  # as many rows as have FLUSH ids together, one at least
                upto = max(row + 1, int(np.searchsorted(ends, ends[row] + FLUSH, "right")) - 1)
                own = lists.slice(row, upto - row)
                valid = pc.is_valid(own).buffers()[1] if own.null_count else None
                text = _spelled(bpe, own.flatten().to_numpy(zero_copy_only=False), ends[row : upto + 1] - ends[row], valid)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, upto - row), text], ["doc", "bytes"])
                row = upto

    return run


@functools.cache
def _vocabulary(path: str | None) -> ByteBPE:
    return ByteBPE(path)


def _shared(df: DataFrame, path: str | None):
    """The vocabulary for all tasks; its size is that of the rank file, about a megabyte."""
    return df.sparkSession.sparkContext.broadcast(_vocabulary(path))


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_bytes: bool = False) -> DataFrame:
    """``(id_col, ids)``: every whole text as token ids, each match of the public pattern encoded by itself.

    ``with_bytes`` adds ``bytes``, decoded from the ids alone.  No shuffle.  A
    null or empty text has no ids; texts and pre-tokens may be of any length.
    Strings of special tokens are ordinary text.  Ids may be null, repeated and
    of any type; an empty table gives no rows; other columns are ignored,
    whatever their names.  ``path`` names a rank file that the driver can read;
    null is the public one of 50,256 tokens.
    """
    base = text_of(docs, id_col, text_col)
    schema = f"doc {base.schema['doc'].dataType.simpleString()}, ids array<int>" + ", bytes binary" * with_bytes
    return base.mapInArrow(_encode(_shared(docs, path), with_bytes), schema).withColumnRenamed("doc", id_col)


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``(id_col, bytes)``: what the ids spell, null for a null list; an id outside the vocabulary is an error."""
    base = encoded.select(F.col(id_col).alias("doc"), F.col(ids_col).alias("ids"))
    schema = f"doc {base.schema['doc'].dataType.simpleString()}, bytes binary"
    return base.mapInArrow(_decode(_shared(encoded, path)), schema).withColumnRenamed("doc", id_col)
