"""Packing by power-of-two decomposition.

A document of ``n`` tokens becomes pieces whose lengths are the longest
sequence, as often as it fits, and the binary digits of what is left.  Every
piece is a sequence of its own, so none crosses documents and none is padded;
equal lengths share a bucket, from which batches are drawn.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, worker_keeps

MAX_LENGTH = 4096
END_ID = 2
#: Bytes that a ``Memo`` may take, by generation: of two, the older is forgotten when the younger is full.
ROOM = 64_000_000
#: A dictionary's share of an entry, in bytes.
ENTRY = 70
#: The same for what a worker of ``pack`` remembers of segments with other characters than plain ones.
SEGMENTS_ROOM = 16_000_000
#: Characters whose distinct pre-tokens are looked up together, those that are cut into pre-tokens at once, and those of one text taken at a time, up to the next blank.
CHUNK, CUT, SLICE = 8_000_000, 1_000_000, 200_000


class Memo(dict):
    """Remembers what ``make`` gives for a key, in at most 2 * ``room`` bytes; keys in use outlive the others."""

    def __init__(self, make, room: int = ROOM):
        super().__init__()
        self.make, self.room, self.held, self.old = make, room, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        size = ENTRY + getsizeof(key) + getsizeof(value)
        if self.held + size > self.room:
            self.old = {}
            if size > self.room:
                return value
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += size
        self[key] = value
        return value


#: What bytes of lower-cased plain texts are.  Beyond ASCII these have letters without a byte E2, and punctuation of three bytes that begin with it.
IS_BLANK, IS_LETTER, IS_DIGIT, IS_OTHER = range(4)
KINDS = np.array([IS_LETTER if i > 127 or chr(i).isalpha() else IS_DIGIT if chr(i).isdigit() else IS_BLANK if i < 33 else IS_OTHER for i in range(256)], "u1")


class SegmentEncoder:
    """Token ids of texts, by distinct pre-tokens or blank-separated segments.

    The tokenizer drops white space before it looks for words, so ids of a text
    are those of its segments in order.  Where all characters are plain, its
    pre-tokens are found here, for many texts at once, and each distinct one
    goes to the tokenizer's model; other segments go through the whole tokenizer
    and are remembered.
    """

    #: Characters that the normalizer lower-cases one by one and otherwise leaves alone: ASCII, letters of Latin and Cyrillic alphabets, and punctuation.
    PLAIN = re.compile("[ -~\n\t\r\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u0148\u014a-\u017e\u0400-\u045f\u2010-\u2027\u20ac]*")
    BLANK = re.compile("[ \n\t\r]")

    def __init__(self, tokenizer_path: str | None):
        from tokenizers import Tokenizer

        if tokenizer_path is None:
            import public_tokenizers

            tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.special = re.compile("|".join(re.escape(x.content) for x in self.added)) if self.added else None
        self.cut = self._words_apart()
        if self.cut:
            self.model, spell = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
            plain = [chr(i) for i in range(33, 0x20AD) if self.PLAIN.fullmatch(chr(i))]
            self.spelling = {byte: letter for c in plain for byte, letter in zip(c.encode(), "".join(x for x, _ in spell(c)), strict=True)}
        self.segments = Memo(self.whole, SEGMENTS_ROOM)

    #: Settings (fixed values of its file) under which blanks part words and ``starts`` finds those of lower-cased plain texts.
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}

    def _words_apart(self) -> bool:
        """Whether the tokenizer, by its own settings, reads a text as its blank-separated segments one by one."""
        if self.tokenizer.truncation or self.tokenizer.padding or any(x.normalized or self.BLANK.search(x.content) for x in self.added):
            return False
        normalizer, words = (json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        steps = words.get("pretokenizers", [])
        return normalizer.get("normalizers") == self.NORMALIZERS and steps[:1] == [self.SPLIT] and [(p["type"], p.get("add_prefix_space"), p.get("use_regex")) for p in steps[1:]] == [("ByteLevel", False, False)]

    @classmethod
    def of_worker(cls, tokenizer_path: str | None) -> SegmentEncoder:
        """The encoder that this Python process keeps from task to task, until another operator runs in it."""
        return worker_keeps(("packing", tokenizer_path), lambda: cls(tokenizer_path))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: bytes) -> bytes:
        """Ids of a pre-token of plain characters; the model's own spelling has a character for each byte."""
        return array("I", [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.spelling))]).tobytes()

    def is_plain(self, text: str) -> bool:
        return self.PLAIN.fullmatch(text) is not None and not (self.special and self.special.search(text))

    @staticmethod
    def starts(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokenizer's own pre-tokens start in lower-cased plain bytes that end with blanks, and which bytes are blank."""
        kind = KINDS[b]
        for i in range(3):
            kind[np.flatnonzero(b == 0xE2) + i] = IS_OTHER
        start = kind != IS_BLANK
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == IS_DIGIT)
        mark = np.flatnonzero((b == ord("'")) & start)
        one, two = b[mark + 1], b[mark + 1].astype("u2") << 8 | b[mark + 2]
        size = np.where(np.isin(one, list(b"stmd")), 1, np.where(np.isin(two, [ord(x) << 8 | ord(y) for x, y in ("re", "ve", "ll")]), 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        after = mark + 1 + size
        start[after] |= kind[after] == IS_LETTER
        return start, kind == IS_BLANK

    def words(self, texts: list[str]) -> tuple[pa.Array, list[int]]:
        """Pre-tokens of plain texts, one after another, and how many there are up to the end of each text."""
        b = np.frombuffer("\0".join([*texts, "\0\0"]).lower().encode(), "u1")
        start, blank = self.starts(b)
        data, offsets = b[~blank], np.flatnonzero(start[~blank])
        words = pa.Array.from_buffers(pa.binary(), len(offsets), [None, pa.py_buffer(np.append(offsets, len(data)).astype("i4")), pa.py_buffer(data)])
        return words, np.searchsorted(np.flatnonzero(start), np.flatnonzero(b == 0)[: len(texts)]).tolist()

    def plain(self, cut: list[tuple[pa.Array, list[int]]]) -> Iterator[bytes]:
        """Ids of plain texts, given as ``words`` gives them; each distinct pre-token is encoded once."""
        number = pa.chunked_array([words for words, _ in cut], pa.binary()).dictionary_encode()
        if not len(number):
            yield from (b"" for _, ends in cut for _ in ends)
            return
        distinct = number.chunk(number.num_chunks - 1).dictionary  # which is that of all
        _, offsets, data = distinct.buffers()
        at, raw = np.frombuffer(offsets, "i4")[: len(distinct) + 1].tolist(), data.to_pybytes() if data else b""
        ids = [self.piece(raw[i:j]) for i, j in zip(at, at[1:])]
        size = np.fromiter(map(len, ids), "i8", len(ids)) // 4
        first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")
        del ids, raw, at
        codes, done = np.concatenate([part.indices.to_numpy() for part in number.chunks]), 0  # without chunks of no words
        for words, ends in cut:
            own, done = codes[done : done + len(words)], done + len(words)
            n = size[own]
            upto = np.append(0, np.cumsum(n))
            place = np.repeat(first[own] - upto[:-1], n)
            place += np.arange(len(place))
            made, stops = flat[place].tobytes(), (4 * upto[ends]).tolist()
            yield from (made[i:j] for i, j in zip([0, *stops], stops))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.cut:
            return [self.whole(t) for t in texts]
        done: list[list[bytes]] = [[] for _ in texts]
        parts: list[str] = []  # plain ones
        places: list[tuple[int, int]] = []  # where in ``done`` the ids of plain parts go
        cut: list[tuple[pa.Array, list[int]]] = []
        fresh = held = 0
        for number, text in enumerate(texts):
            at = 0
            while at < len(text):
                blank = self.BLANK.search(text, at + SLICE)
                end = blank.start() if blank else len(text)
                part, at = text[at:end], end
                whole = self.is_plain(part)
                for own in [part] if whole else self.BLANK.split(part):
                    if whole or self.is_plain(own):
                        parts.append(own)
                        places.append((number, len(done[number])))
                        done[number].append(b"")
                    else:
                        done[number].append(self.segments[own])
                fresh, held = fresh + len(part), held + len(part)
                if fresh > CUT:
                    cut.append(self.words(parts))
                    parts, fresh = [], 0
                if held > CHUNK:
                    self._settle(done, places, cut)
                    held = 0
        if parts:
            cut.append(self.words(parts))
        self._settle(done, places, cut)
        return [b"".join(ids) for ids in done]

    def _settle(self, done: list[list[bytes]], places: list[tuple[int, int]], cut: list[tuple[pa.Array, list[int]]]) -> None:
        """Puts the ids of plain parts that are cut in their places; the others wait."""
        for (text, place), ids in zip(places, self.plain(cut)):
            done[text][place] = ids
        del places[: sum(len(ends) for _, ends in cut)]
        cut.clear()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """``n`` as a sum of powers of two of at most ``longest``, the longest first."""
    return [longest] * (n // longest) + [1 << b for b in reversed(range(longest.bit_length() - 1)) if n % longest >> b & 1]


SCHEMA = "doc bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids array<int>"


def _pieces(tokenizer_path: str | None, end_id: int, longest: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = SegmentEncoder.of_worker(tokenizer_path), np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            doc, start, length, crc, total, ids = zip(*rows) if rows else [()] * 6
            columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)]
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("i4")
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), values))
            return pa.RecordBatch.from_arrays(columns, ["doc", "start", "length", "ids_crc32", "doc_tokens", "ids"])

        def pieces(docs: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal rows, held
            for doc, ids in zip(docs, encoder.encode_all(texts)):
                ids, start = ids + end, 0
                for length in piece_lengths(len(ids) // 4, longest):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(own), len(ids) // 4, own if with_ids else b""))
                    start, held = start + length, held + length
                    if held > 1_000_000 or len(rows) > 20_000:
                        yield flush()
                        rows, held = [], 0

        docs, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size > CHUNK or len(docs) > 100_000:
                    yield from pieces(docs, texts)
                    docs, texts, size = [], [], 0
        yield from pieces(docs, texts)
        if rows:
            yield flush()

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
    end_id: int = END_ID, longest: int = MAX_LENGTH, with_ids: bool = True,
) -> DataFrame:
    """Tokenize every whole text and return its pieces, each a full sequence of a power-of-two length.

    One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` (0: a sequence has one piece),
    ``bucket`` (log2 of the length) and, if ``with_ids``, ``ids``.  Write it with
    ``partitionBy("bucket")`` to get one folder per length.

    No shuffle: pieces are numbered by partition and row.  A null or empty text
    is its end id alone; texts may be of any length.  Rows repeated with one id
    are packed each; ids are integers, or null.  An empty table gives an empty
    result; other columns are ignored.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    base = text_of(docs, id_col, text_col)
    kind = base.schema["doc"].dataType
    made = base.withColumn("doc", F.col("doc").cast("bigint")).mapInArrow(_pieces(tokenizer_path, end_id, longest, with_ids), SCHEMA)
    out = made.select(
        F.col("doc").cast(kind).alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
        F.log2("length").cast("int").alias("bucket"), "ids",
    )
    return out if with_ids else out.drop("ids")
