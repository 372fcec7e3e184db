"""Substring deduplication over a log-structured fingerprint index.

A window of 20 words is fingerprinted by its anchor: the least hash of the
8-word shingles inside it.  Equal windows have equal anchors, and neighbouring
windows mostly share theirs, so the index holds one hash for about seven
windows, and the hashes of the windows themselves only for anchors that came
twice.  It is a log of sorted immutable runs.  A new batch of documents is
merge-joined with the runs, fragment by fragment of the hash order: first by
anchors, then by the windows of those that were met; a document of the history
is read again only if it alone had such an anchor.  Windows that were met are
verified by a digest of the words of both.  Then the batch becomes a run
itself, and runs are compacted when there are many.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, remove, shared_dir, text_of
from .fragments import PACKED, as_lists, fragment_of, fragments_for, merged, pack, recut
from .shingles import mixed, signed, windows, word_hashes

WINDOW, SHINGLE = 20, 8
#: Anchors that a fragment of a run holds at most, about: they bound what a task holds at a time.
FRAGMENT_ROWS = 1_000_000
#: Characters of a text for which there is an anchor, about.
CHARS_PER_ANCHOR = 40
#: Runs that an index lets gather before it merges them into one for the next batch to meet.
MAX_RUNS = 2
#: Where a table is cut into the batches that its index is fed: a large first one, and smaller ones that meet it.
CUTS = (0.8, 0.9)


def _anchors(shingles: np.ndarray, size: int, shingle: int) -> np.ndarray:
    """Per window the least shingle hash inside it."""
    n, span = len(shingles) - (size - shingle), size - shingle + 1
    if n <= 0:
        return np.zeros(0, "u8")
    least, width = shingles, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    return np.minimum(least[: len(least) - rest], least[rest:])[:n] if rest else least[:n]


def window_anchors(words: np.ndarray, size: int = WINDOW, shingle: int = SHINGLE) -> np.ndarray:
    return _anchors(windows(words, shingle), size, shingle)


def _spans(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and how long they are."""
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return at, np.diff(np.append(at, len(values)))


def _batch_runs(size: int, fragments: int):
    """The anchors of a batch of documents, sorted and cut into fragments.  An anchor that the batch has twice
    is in ``shared_*`` with each document, and once more without a document for other batches to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = []
            for words, edges in word_hashes(batch.column(1)):
                shingles = windows(words, SHINGLE)
                least = _anchors(shingles, size, SHINGLE)
                for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    found = least[low : max(low, high - size + 1)]
                    found = np.unique(found[_spans(found)[0]])
                    # Equal windows of one text have their anchor's shingle at two places.
                    own = np.sort(shingles[low : max(low, high - SHINGLE + 1)])
                    twice = own[1:][own[1:] == own[:-1]]
                    anchors += [found, found[np.isin(found, twice)]] if len(twice) else [found, twice]
            docs = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype("i8"), [len(x) + len(y) for x, y in zip(anchors[::2], anchors[1::2])])
            tokens = np.concatenate(anchors) if anchors else np.zeros(0, "u8")
            yield pack(tokens, docs, fragments)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge-joins the rows of each fragment, those of the new batch (``old`` false) first: ``(token, doc)`` of
    anchors that the batch has and any other place has too, with documents of the history that alone had one."""

    def pairs(tokens: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(docs)], ["token", "doc"])

    fragment, tokens, docs, alone, hit = None, None, None, None, None
    for batch in batches:
        for i, (f, old) in enumerate(zip(batch.column(0).to_pylist(), batch.column(6).to_pylist())):
            own, own_docs, own_alone, s_tokens, s_docs = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(1, 6))
            own_alone = own_alone.astype(bool)
            if f != fragment:
                if tokens is not None and hit.any():
                    yield pairs(tokens[hit & alone], docs[hit & alone])
                fragment, tokens = f, None
            if not old:
                # Of a batch's run, one row of a fragment has the anchors, sorted; the others pass repeated ones on.
                if len(own):
                    tokens, docs, alone, hit = own, own_docs, own_alone, np.zeros(len(own), bool)
                if len(s_tokens):
                    yield pairs(s_tokens, s_docs)
            elif tokens is not None:
                at = np.minimum(np.searchsorted(tokens.view("u8"), own.view("u8")), len(tokens) - 1)
                same = tokens[at] == own
                hit[at[same]] = True
                # Windows of an anchor that several documents had are in the index.
                if (same & own_alone).any():
                    yield pairs(own[same & own_alone], own_docs[same & own_alone])
    if tokens is not None and hit.any():
        yield pairs(tokens[hit & alone], docs[hit & alone])


WINDOW_NAMES = ["fragment", "hashes", "docs", "starts", "fresh"]
WINDOWS = "fragment int, hashes array<bigint>, docs array<bigint>, starts array<int>, fresh array<boolean>, verified array<int>, numbers array<int>"
#: As a run keeps them.
KEPT = "fragment int, hashes array<bigint>, docs array<bigint>, starts array<int>"
LATER = "doc bigint, starts array<int>, first_docs array<bigint>, first_starts array<int>"


def _later(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows, positions of each sequence's first one, of those of new documents that come after it, and of the first ones to these."""
    order = np.lexsort((starts, docs, fresh, hashes))
    h, d, s = hashes[order], docs[order], starts[order]
    first = np.append(True, h[1:] != h[:-1])[: len(h)]
    group = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h) else np.zeros(0, "i8")
    after = ((d != d[group]) | (s != s[group])) & fresh[order]
    return order[first], order[after], order[group[after]]


def _segments(docs: np.ndarray, starts: np.ndarray, first_docs: np.ndarray, first_starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows that follow each other in both documents, as ``(doc, start, first_doc, first_start, number)``."""
    order = np.lexsort((starts, first_starts - starts, first_docs, docs))
    d, s, fd, fs = docs[order], starts[order], first_docs[order], first_starts[order]
    new = np.append(True, (d[1:] != d[:-1]) | (fd[1:] != fd[:-1]) | (s[1:] != s[:-1] + 1) | (fs[1:] != fs[:-1] + 1))[: len(d)]
    at = np.flatnonzero(new)
    return d[at], s[at], fd[at], fs[at], np.diff(np.append(at, len(d)))


class _Split(dict):
    """Words of the texts that are asked for."""

    def __init__(self, texts: dict[int, pa.Scalar]):
        self.texts = texts

    def __missing__(self, doc: int) -> list[bytes]:
        words = self[doc] = self.texts[doc].as_buffer().to_pybytes().split()
        return words


def _candidate_windows(size: int, fragments: int):
    """Windows whose anchor was met: per fragment each sequence's first one in the batch.  Those of new documents
    that come after it are compared with it word by word at once, and go out by document (``verified``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, texts, rows = [], {}, zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist())
            for words, edges in word_hashes(batch.column(1)):
                least, whole = window_anchors(words, size), windows(words, size)
                for low, high, (doc, text, tokens, fresh) in zip(edges[:-1].tolist(), edges[1:].tolist(), rows):
                    anchors, met = least[low : max(low, high - size + 1)], np.sort(tokens.values.to_numpy().view("u8"))
                    begin, times = _spans(anchors)
                    own = anchors[begin]
                    at = np.flatnonzero(np.repeat(met[np.minimum(np.searchsorted(met, own), len(met) - 1)] == own, times))
                    if len(at):
                        texts[doc] = text
                        parts.append((whole[low + at], np.full(len(at), doc, "i8"), at, np.full(len(at), fresh)))
            if not parts:
                continue
            hashes, docs, starts, fresh = (np.concatenate(x) for x in zip(*parts))
            first, after, to = _later(hashes, docs, starts, fresh)
            found: dict[int, list[np.ndarray]] = {}
            wrong, split = np.zeros(0, "i8"), _Split(texts)
            for d, s, fd, fs, n in zip(*(x.tolist() for x in _segments(docs[after], starts[after], docs[to], starts[to]))):
                if split[d][s : s + n + size - 1] == split[fd][fs : fs + n + size - 1]:
                    found.setdefault(d, []).append((s, n))
                else:  # two sequences with equal hashes: the later one is sent on, and judged by digest
                    wrong = np.concatenate([wrong, after[(docs[after] == d) & (starts[after] >= s) & (starts[after] < s + n)]])
            if found:
                none = as_lists(np.zeros(len(found) + 1, "i4"), np.zeros(0, "i8"))
                lists = np.array([x for own in found.values() for x in own], "i4")
                bounds = np.cumsum([0, *map(len, found.values())]).astype("i4")
                whose = as_lists(np.arange(len(found) + 1, dtype="i4"), np.fromiter(found, "i8", len(found)))
                empty = as_lists(np.zeros(len(found) + 1, "i4"), np.zeros(0, "i4"), np.zeros(0, bool))
                dealt = fragment_of(mixed(np.fromiter(found, "i8", len(found)).view("u8")), fragments).astype("i4")
                yield pa.RecordBatch.from_arrays([pa.array(dealt), *none, *whose, *empty, *as_lists(bounds, lists[:, 0].copy(), lists[:, 1].copy())], [*WINDOW_NAMES, "verified", "numbers"])
            first = np.sort(np.concatenate([first, wrong]))  # by document and start, which compresses well
            hashes, docs, starts, fresh = (x[first] for x in (hashes, docs, starts, fresh))
            fragment = fragment_of(hashes, fragments)
            order = np.argsort(fragment, kind="stable")
            bounds = np.searchsorted(fragment[order], np.arange(fragments + 1)).astype("i4")
            columns = as_lists(bounds, signed(hashes[order]), docs[order], starts[order].astype("i4"), fresh[order])
            verified = as_lists(np.zeros(fragments + 1, "i4"), np.zeros(0, "i4"), np.zeros(0, "i4"))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(fragments, dtype="i4")), *columns, *verified], [*WINDOW_NAMES, "verified", "numbers"]).filter(pa.array(np.diff(bounds) > 0))

    return run


def _repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads fragments one after another; a sequence comes once a batch at most."""
    fragment, held = None, []

    def flush() -> pa.RecordBatch:
        hashes, docs, starts, fresh = (np.concatenate(x) for x in zip(*held))
        _, after, to = _later(hashes, docs, starts, fresh.astype(bool))
        after, to = (x[np.lexsort((starts[after], docs[after]))] for x in (after, to))
        d = docs[after]
        at = np.flatnonzero(np.append(True, d[1:] != d[:-1])[: len(d)])
        bounds = np.append(at, len(d)).astype("i4")
        lists = as_lists(bounds, starts[after].astype("i4"), docs[to], starts[to].astype("i4"))
        return pa.RecordBatch.from_arrays([pa.array(d[at]), *lists], ["doc", "starts", "first_docs", "first_starts"])

    for batch in batches:
        for i, f in enumerate(batch.column(0).to_pylist()):
            if f != fragment and held:
                yield flush()
                held = []
            fragment = f
            held.append([batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(1, 5)])
    if held:
        yield flush()


def _first_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sequence's first window, fragment by fragment."""
    fragment, held = None, []

    def flush() -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held)]
        first, _, _ = _later(*columns, np.zeros(len(columns[0]), bool))
        first = np.sort(first)
        return pa.RecordBatch.from_arrays([pa.array([fragment], pa.int32()), *as_lists(np.array([0, len(first)], "i4"), *(x[first] for x in columns))], WINDOW_NAMES[:4])

    for batch in batches:
        for i, f in enumerate(batch.column(0).to_pylist()):
            if f != fragment and held:
                yield flush()
                held = []
            fragment = f
            held.append([batch.column(c)[i].values.to_numpy() for c in range(1, 4)])
    if held:
        yield flush()


def _recut_windows(fragments: int):
    """Rows of windows, cut into other fragments than they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = [batch.column(c)[i].values.to_numpy() for c in range(1, 4)]
                fragment = fragment_of(columns[0].view("u8"), fragments)
                order = np.argsort(fragment, kind="stable")
                bounds = np.searchsorted(fragment[order], np.arange(fragments + 1)).astype("i4")
                out = pa.RecordBatch.from_arrays([pa.array(np.arange(fragments, dtype="i4")), *as_lists(bounds, *(x[order] for x in columns))], WINDOW_NAMES[:4])
                yield out.filter(pa.array(np.diff(bounds) > 0))

    return run


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's later windows as segments."""
    for batch in batches:
        for i in range(batch.num_rows):
            parts = [batch.column(1)[i].values.field(c).flatten().to_numpy() for c in range(3)]
            doc = batch.column(0)[i].as_py()
            columns = _segments(np.full(len(parts[0]), doc, "i8"), parts[0].astype("i8"), parts[1], parts[2].astype("i8"))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype("i8")) for x in columns], ["doc", "start", "first_doc", "first_start", "number"])


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _digests(size: int):
    """Digests of the words of passages of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = text.as_buffer().to_pybytes().split()
                rows += [(doc, w["first_start"], w["number"], _digest(words[w["first_start"] : w["first_start"] + w["number"] + size - 1])) for w in wanted]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["first_doc", "first_start", "number", "digest"])

    return run


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints in shared storage, and a manifest that names them.

    ``dedup`` merge-joins a new batch with the runs, verifies what it meets,
    and appends the batch as a run; ``compact`` merges the runs.  Nothing is
    changed in place: a run is written before a new version of the manifest
    names it, so an index opened by its ``path``, at any time and by any
    session, is whole.  Texts are not kept; ``dedup`` reads those it has to
    verify from the corpus that it is given.
    """

    MANIFEST = "version bigint, size int, fragments int, runs array<struct<anchors:string,windows:string,fragments:int,rows:bigint>>, numbers array<string>, next bigint"
    NUMBERS = "n_doc bigint, h bigint, row bigint"

    def __init__(self, spark: SparkSession, path: str | None = None, size: int = WINDOW, fragments: int | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.version, self.size, self.runs, self.numbers, self.next = 0, size, [], [], 0
        self.fragments = fragments or fragments_for(1, FRAGMENT_ROWS, max(512, 2 * self._parts()))
        last = spark.read.schema(self.MANIFEST).json(f"{self.path}/manifest/*").orderBy(F.desc("version")).limit(1).collect() if path and self._exists() else []
        for row in last:
            self.version, self.size, self.fragments, self.runs = row.version, row["size"], row.fragments, [tuple(r) for r in row.runs]
            self.numbers, self.next = list(row.numbers or ()), row.next or 0

    def _parts(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def _name(self, runs: list[tuple]) -> None:
        """A new version of the manifest."""
        self.spark.createDataFrame([(self.version + 1, self.size, self.fragments, runs, self.numbers, self.next)], self.MANIFEST).coalesce(1).write.json(f"{self.path}/manifest/{self.version + 1:09d}")
        self.version, self.runs = self.version + 1, runs

    def _merged(self, rows: DataFrame) -> DataFrame:
        return merged(rows, min(self.fragments, self._parts()))

    def _write(self, rows: DataFrame, kind: str) -> str:
        path = f"{self.path}/{kind}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        return path

    def _read(self, path: str, fragments: int) -> DataFrame:
        rows = self.spark.read.schema(PACKED).parquet(path)
        return rows if fragments == self.fragments else recut(rows, self.fragments)

    def anchors(self) -> DataFrame:
        """The packed anchors of all runs, cut as the index is now; which documents share one is no longer asked."""
        out, none = self.spark.createDataFrame([], PACKED), F.array().cast("array<bigint>")
        for path, _, fragments, _ in self.runs:
            out = out.union(self._read(path, fragments).where(F.size("tokens") > 0).select("fragment", "tokens", "docs", "alone", none, none))
        return out

    def windows(self) -> DataFrame:
        """The windows of all runs whose anchors came twice, by fragment."""
        out = self.spark.createDataFrame([], KEPT)
        for _, path, fragments, _ in self.runs:
            rows = self.spark.read.schema(KEPT).parquet(path).where(F.size("hashes") > 0)
            out = out.union(rows if fragments == self.fragments else rows.mapInArrow(_recut_windows(self.fragments), KEPT))
        return out

    def _add(self, anchors: str, windows: str) -> None:
        rows = self.spark.read.schema(PACKED).parquet(anchors).agg(F.sum(F.size("tokens")).alias("n")).first()["n"] or 0
        self._name([*self.runs, (anchors, windows, self.fragments, rows)])

    def number(self, docs: DataFrame) -> tuple[DataFrame, str]:
        """``(doc, text, row)``: a number of its own, above all that the index has given, for every pair of an id and a text, in the order of ids.

        Returned with the table of numbers, which ``dedup`` has to be told.
        """
        known = docs.where("doc IS NOT NULL").select(F.col("doc").alias("n_doc"), F.xxhash64("text").alias("h")).distinct().orderBy("n_doc", "h")
        path = self._write(known.withColumn("row", F.lit(self.next) + F.monotonically_increasing_id()), "numbers")
        return self._with_rows(docs, [path], "left"), path

    def _with_rows(self, docs: DataFrame, paths: list[str], how: str) -> DataFrame:
        rows = self.spark.read.schema(self.NUMBERS).parquet(*paths) if paths else self.spark.createDataFrame([], self.NUMBERS)
        return docs.join(rows, (F.col("doc") == F.col("n_doc")) & (F.xxhash64("text") == F.col("h")), how).select("doc", "text", "row")

    def numbered(self, history: DataFrame) -> DataFrame:
        """``(doc, text)`` of the documents of ``history`` that the index has taken in, by their numbers."""
        return self._with_rows(history, self.numbers, "inner").select(F.col("row").alias("doc"), "text")

    def compact(self) -> None:
        """Merges the runs into one, in more fragments if they have grown.  The old ones go once the manifest no longer names them."""
        if len(self.runs) > 1:
            before = [path for r in self.runs for path in r[:2]]
            self.fragments = max(self.fragments, fragments_for(sum(r[3] for r in self.runs), FRAGMENT_ROWS, 1))
            windows = self._by_fragment(self.windows()).mapInArrow(_first_windows, KEPT)
            anchors, windows = self._write(self._merged(self.anchors()), "anchors"), self._write(windows, "windows")
            self._name([(anchors, windows, self.fragments, sum(r[3] for r in self.runs))])
            remove(self.spark, *before)

    def _by_fragment(self, rows: DataFrame, *then) -> DataFrame:
        return rows.repartition(min(self.fragments, self._parts()), "fragment").sortWithinPartitions("fragment", *then)

    def dedup(self, new: DataFrame, history: DataFrame | None = None, numbers: str | None = None, forget: bool = False) -> DataFrame:
        """Judges the windows of ``new(doc, text)`` by the index and by ``new`` itself, and appends it.

        Without ``numbers`` the ids are numbers that the index has not given
        out, one for each document; they are written down unless the index is
        to ``forget`` which documents they are.

        Runs are compacted before, if there are many, and the batch meets the one they became.
        ``history(doc, text)`` has the documents taken in before, and may have
        others.  A window repeats what starts in them, or earlier in ``new``: at
        a smaller id, or before it in the same document.  Returns ``(doc, start,
        number, digest)``: ``number`` windows from ``start`` on, with the digest
        of the words there if they still have to be compared with it.
        """
        if len(self.runs) >= MAX_RUNS:
            self.compact()
        if not numbers and not forget:
            numbers = self._write(new.select(F.col("doc").alias("n_doc"), F.xxhash64("text").alias("h"), F.col("doc").alias("row")), "numbers")
        anchors = self._write(self._merged(new.mapInArrow(_batch_runs(self.size, self.fragments), PACKED)), "anchors")
        rows = self._read(anchors, self.fragments).withColumn("old", F.lit(False)).union(self.anchors().withColumn("old", F.lit(True)))
        pairs = self._by_fragment(rows, "old", F.size("tokens") == 0).mapInArrow(_met, "token bigint, doc bigint")
        wanted = materialize(pairs.groupBy(F.col("doc").alias("w_doc")).agg(F.collect_set("token").alias("tokens")), "met-anchors")
        texts = new.select("doc", "text", F.lit(True).alias("fresh"))
        seen = None
        if self.runs:
            if history is None:
                raise ValueError("the texts of documents that are in the index are needed to verify windows")
            seen = history.select("doc", "text", F.lit(False).alias("fresh"))
        found, windows = self._judge(texts, seen, wanted)
        if numbers:
            self.numbers = [*self.numbers, numbers]
            given = self.spark.read.schema(self.NUMBERS).parquet(numbers).agg(F.max("row").alias("n")).first()["n"]
            self.next = self.next if given is None else max(self.next, given + 1)
        self._add(anchors, windows)
        return found

    def _judge(self, new: DataFrame, old: DataFrame | None, wanted: DataFrame) -> tuple[DataFrame, str]:
        """The repeated windows of ``new``, and where all windows that had to be met are kept."""
        # The side without texts is hashed, so that texts needn't be sorted.
        pick = lambda df: df.join(wanted.hint("shuffle_hash"), F.col("doc") == F.col("w_doc")).select("doc", "text", "tokens", "fresh")
        cut = _candidate_windows(self.size, self.fragments)
        made = pick(new).mapInArrow(cut, WINDOWS)
        if old is not None:
            made = made.union(pick(old).mapInArrow(cut, WINDOWS))
        windows = self._write(made, "windows")
        made = self.spark.read.schema(WINDOWS).parquet(windows)
        fresh = made.where(F.size("hashes") > 0).drop("verified", "numbers")
        verified = made.where(F.size("verified") > 0).select(F.col("docs")[0].alias("doc"), F.explode(F.arrays_zip("verified", "numbers")).alias("v"))
        verified = verified.select("doc", F.col("v.verified").cast("bigint").alias("start"), F.col("v.numbers").cast("bigint").alias("number"), F.lit(None).cast("binary").alias("digest"))
        known = self.windows().withColumn("fresh", F.transform("starts", lambda _: F.lit(False)))
        later = self._by_fragment(fresh.union(known)).mapInArrow(_repeated_windows, LATER).groupBy("doc").agg(F.collect_list(F.struct("starts", "first_docs", "first_starts")).alias("later"))
        segments = materialize(later.mapInArrow(_references, "doc bigint, start bigint, first_doc bigint, first_start bigint, number bigint"), "segments")
        # Copies refer to the same passages, whose digests are taken once.
        passages = segments.select("first_doc", "first_start", "number").distinct().groupBy("first_doc").agg(F.collect_list(F.struct("first_start", "number")).alias("wanted"))
        digests = None
        for texts in (new, old) if old is not None else (new,):
            own = texts.join(passages.hint("shuffle_hash"), F.col("doc") == F.col("first_doc")).select("doc", "text", "wanted").mapInArrow(_digests(self.size), "first_doc bigint, first_start bigint, number bigint, digest binary")
            digests = own if digests is None else digests.union(own)
        # Rows repeated with one id give one digest each.
        digests = digests.distinct()
        checked = segments.join(digests, ["first_doc", "first_start", "number"]).select("doc", "start", "number", "digest")
        found = materialize(verified.union(checked), "repeated-windows")
        discard(wanted, segments)
        return found, windows


def _remove(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n_words, n_removed, digest, kept = [], [], [], []
                for text, found in zip(part.column(1), part.column(2)):
                    words = text.as_buffer().to_pybytes().split()
                    stay = words
                    if found.is_valid:
                        edge = np.zeros(len(words) + 1, "i4")
                        starts, numbers = (found.values.field(c).to_numpy() for c in ("start", "number"))
                        for start, number, same in zip(starts.tolist(), numbers.tolist(), found.values.field("digest").to_pylist()):
                            end = start + number + size - 1
                            if same is None or same == _digest(words[start:end]):
                                edge[start] += 1
                                edge[end] -= 1
                        stay = list(itertools.compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                    out = b" ".join(stay)
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(stay))
                    digest.append(hashlib.sha256(out).hexdigest())
                    kept.append(out.decode("utf-8", "surrogatepass") if with_text else None)
                columns = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _numbered(base: DataFrame) -> DataFrame:
    """``(doc, text, row)``: ``row`` is the id, or in tables where an id has several texts a number of its own for each, in the order of ids."""
    if not base.where("doc IS NOT NULL").groupBy("doc").count().where("count > 1").limit(1).count():
        return base.withColumn("row", F.col("doc"))
    known = base.where("doc IS NOT NULL").select("doc", F.xxhash64("text").alias("h"))
    several = known.groupBy("doc").agg((F.min("h") != F.max("h")).alias("differ")).where("differ")
    if not several.limit(1).count():
        return base.withColumn("row", F.col("doc"))
    rows = materialize(known.distinct().orderBy("doc", "h").withColumn("row", F.monotonically_increasing_id()), "rows")
    own = (F.col("doc") == F.col("r_doc")) & (F.xxhash64("text") == F.col("h"))
    return base.join(rows.withColumnRenamed("doc", "r_doc"), own, "left").select("doc", "text", "row")


def substring_dedup(
    docs: DataFrame, index: FingerprintIndex | None = None, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW,
    batch_cuts: Sequence[float] = CUTS, with_text: bool = True,
) -> DataFrame:
    """Remove words covered by windows of ``size`` words that also start earlier in the corpus.

    Earlier is a smaller id, or an earlier start in the same document; windows
    are judged on the texts as given.  The documents go into an index of their
    own in batches, which are ranges of ids between the quantiles ``batch_cuts``.  If an ``index`` is given, its documents,
    whose texts ``history`` has under the same column names, are earlier than
    all of ``docs``, which goes in as one batch.  Documents of an index are
    known by id and text, so an id may come again.

    Returns one row per input row: ``id_col``, ``n_words``, ``n_removed``,
    ``kept_sha256`` and, if ``with_text``, ``kept_text``.

    Null text has no words, a text shorter than a window loses none; texts may
    be of any length.  A row with a null id keeps all words and counts as
    earlier for nobody.  Rows repeated with one id and text are one document;
    those with one id and different texts are documents of their own, one after
    another.  Windows whose words differ are never taken for equal: what a
    64-bit hash finds is compared word by word or by SHA-256; a collision of
    that hash could only leave a repeated window in place.  An empty table
    gives an empty result; other columns are ignored.  Ids must be integers.
    """
    base = text_of(docs, id_col, text_col)
    kind = base.schema["doc"].dataType
    base = base.withColumn("doc", F.col("doc").cast("bigint"))
    session = base.sparkSession
    numbers = None
    if index is not None:
        base, numbers = index.number(base)
    else:
        base = _numbered(base)
    # Dealt out by row once; no later join moves a text again.
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    base.withColumn("chars", F.length("text")).repartition(parts, "row").write.bucketBy(parts, "row").sortBy("row").option("compression", "zstd").option("path", f"{shared_dir(session)}/{name}").saveAsTable(name)
    base = session.table(name)
    known = base.where("row IS NOT NULL").select(F.col("row").alias("doc"), "text")
    if index is not None:
        past = None
        if history is not None:
            past = text_of(history, id_col, text_col)
            past = index.numbered(past.withColumn("doc", F.col("doc").cast("bigint")))
        found = [index.dedup(known, past, numbers)]
    else:
        chars = base.agg(F.sum("chars").alias("n")).first()["n"] or 0
        index = FingerprintIndex(session, size=size, fragments=fragments_for(chars // CHARS_PER_ANCHOR, FRAGMENT_ROWS, max(512, 2 * parts)))
        cuts = known.approxQuantile("doc", list(batch_cuts), 0.01) if batch_cuts else []
        edges = [None, *sorted({int(x) for x in cuts}), None]
        found = []
        for low, high in zip(edges, edges[1:]):
            part = known.where(F.col("doc") > low) if low is not None else known
            part = part.where(F.col("doc") <= high) if high is not None else part
            found.append(index.dedup(part, known.where(F.col("doc") <= low) if low is not None else None, forget=True))
    repeated = found[0]
    for more in found[1:]:
        repeated = repeated.union(more)
    repeated = repeated.groupBy(F.col("doc").alias("f_doc")).agg(F.collect_list(F.struct("start", "number", "digest")).alias("found"))
    judged = base.join(repeated.hint("shuffle_hash"), F.col("row") == F.col("f_doc"), "left").select("doc", "text", "found")
    out = judged.mapInArrow(_remove(size, with_text), "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    out = out.select(F.col("doc").cast(kind).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept_text")
    return out if with_text else out.drop("kept_text")
