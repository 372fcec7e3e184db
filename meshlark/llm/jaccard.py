"""N-gram Jaccard join by vertical partitioning.

The order of all shingles is that of their hashes.  It is cut into fragments
that are handled apart: in each, shingles that two documents have in their
prefixes are found, and for candidate pairs partial overlaps are counted, then
summed per pair.

Two sets of sizes n and m link when their overlap is at least
``least_overlap(n, m)``; then they share a shingle among the first n/4+1 of
either.  Of the pairs so found, only those between different components need a
count.  First every shingle's documents meet one leader, the one that holds the
most widely shared shingles, and what has been linked is merged.  Then the
documents that are still apart, and share enough shingles with other
components, bring in their whole sets.  They meet leaders once more; at last,
with whole sets ordered by frequency and what a component has for itself alone
left out, prefixes are so rare that only pairs near the threshold meet.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, text_of
from .components import components
from .fragments import PACKED, fragments_for, merged, pack, shared
from .shingles import mixed, shingle_sets, signed

SIZE = 5
#: All prefixes reach at least this far in the order: three tenths of the hashes.
FLOOR = np.uint64((1 << 64) * 3 // 10)
#: Fragments of the order in which overlaps of a pair are counted apart.
FRAGMENTS = 4
#: Rounds in which documents meet leaders, and how many of them each at most; this saves pairs and loses none.
LEADER_ROUNDS, LEADERS = 1, 8
#: Sizes of sets that differ by this factor share a prefix length in the last round.
BAND = 1.02
#: Longs of a set's signature in the last round.
SIGNATURE = 16
CUTS = np.array([(f << 64) // FRAGMENTS for f in range(1, FRAGMENTS)], "u8")
#: Prefix shingles that a fragment's task holds at a time, on average.
FRAGMENT_ROWS = 1_000_000


def least_overlap(n: Column, m: Column) -> Column:
    """Shingles that sets of these sizes must share for 100 * intersection >= 75 * union."""
    return F.ceil((n + m) * 3 / 7)


def prefix_of(shingles: np.ndarray) -> np.ndarray:
    """The first n/4+1 shingles in order, and all up to FLOOR."""
    return shingles[: max(len(shingles) // 4 + 1, int(np.searchsorted(shingles, FLOOR, "right")))]


def _profiles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prefix, low, half, digest = [], [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                prefix.append(len(prefix_of(s)))
                low.append(int(np.searchsorted(s, FLOOR, "right")))
                half.append(int(np.searchsorted(s, CUTS[FRAGMENTS // 2 - 1])))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, prefix, low, half)), pa.array(digest, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "prefix", "low", "half", "digest"])

    return run


def _packed_prefixes(size: int, fragments: int):
    """Prefix shingles of a batch of documents, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [prefix_of(s) for s in shingle_sets(batch.column(1), size)]
            docs = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype("i8"), [len(s) for s in sets])
            yield pack(np.concatenate(sets) if sets else np.zeros(0, "u8"), docs, fragments)

    return run


def _segments(size: int):
    """A document's whole set, cut into the fragments of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows, fragments, segments = batch.slice(at, 500), [], [], []
                for i, s in enumerate(shingle_sets(part.column(1), size)):
                    bounds = np.searchsorted(s, CUTS)
                    for f, segment in enumerate(np.split(s, bounds)):
                        if len(segment):
                            rows.append(i)
                            fragments.append(f)
                            segments.append(signed(segment))
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(fragments, pa.int32()), pa.array(segments, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "fragment", "segment"])

    return run


def shared_prefixes(base: DataFrame, size: int) -> DataFrame:
    """``(token, doc)`` for every shingle that is in two prefixes."""
    session = base.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    # A text has a prefix shingle for about 20 characters.
    total = base.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    # Prefixes lie in the first third of the order, and so do most of their fragments.
    fragments = 4 * fragments_for(int(total) // 20, FRAGMENT_ROWS, 2 * parts)
    return shared(merged(base.mapInArrow(_packed_prefixes(size, fragments), PACKED), parts))


class Segments:
    """The sets of candidate documents in fragments, as a table bucketed by document: a pair finds them without moving them."""

    def __init__(self, texts: DataFrame, size: int):
        self.session = texts.sparkSession
        parts = int(self.session.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"segments_{uuid.uuid4().hex}"
        made = texts.mapInArrow(_segments(size), "doc bigint, fragment int, segment array<bigint>")
        # Rows repeated with one id count once.
        made.repartition(parts, "doc").dropDuplicates(["doc", "fragment"]).write.bucketBy(parts, "doc").sortBy("doc").option("compression", "zstd").option("path", f"{shared_dir(self.session)}/{self.name}").saveAsTable(self.name)
        self.table = self.session.table(self.name)

    def drop(self) -> None:
        self.session.sql(f"DROP TABLE IF EXISTS {self.name}")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of ``pairs(a, b, n_a, n_b)`` those that link: partial overlaps per fragment, summed per pair.

        ``a`` may be a leader with many partners: its segments are few rows, and
        the side with the partners is split by adaptive execution.
        """
        pairs = materialize(pairs.select("a", "b", "n_a", "n_b"), "pairs")
        leaders = materialize(self.table.join(pairs.select(F.col("a").alias("doc")).distinct(), "doc").select(F.col("doc").alias("l_doc"), F.col("fragment").alias("l_fragment"), F.col("segment").alias("l_segment")), "leaders")
        members = pairs.join(self.table, F.col("b") == F.col("doc")).select("a", "b", "n_a", "n_b", "fragment", "segment")
        partial = members.join(leaders, (F.col("a") == F.col("l_doc")) & (F.col("fragment") == F.col("l_fragment")))
        partial = partial.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("segment", "l_segment")).alias("overlap"))
        summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
        return summed.where(F.col("overlap") >= least_overlap(F.col("n_a"), F.col("n_b"))).select("a", "b")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links between documents."""
    links = materialize(links, "pair-links")
    if not links.limit(1).count():
        return labels
    c = labels.select("doc", "component")
    between = links.join(c.withColumnsRenamed({"doc": "a", "component": "c_a"}), "a").join(c.withColumnsRenamed({"doc": "b", "component": "c_b"}), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    found = components(between).withColumnRenamed("component", "merged")
    new = labels.join(found, F.col("component") == F.col("node"), "left").select("doc", "n", "prefix", "low", "half", F.coalesce("merged", "component").alias("component"))
    return materialize(new, "labels")


def _with_members(labels: DataFrame) -> DataFrame:
    """``(doc, component, members)``."""
    return labels.join(labels.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "component").select("doc", "component", "members")


def _entries(sets: DataFrame, tokens: str, labels: DataFrame) -> DataFrame:
    """A row per document and shingle of the column ``tokens``."""
    rest = [c for c in ("n", "low", "half", "central") if c in sets.columns]
    return sets.join(_with_members(labels), "doc").select(F.explode(tokens).alias("token"), "doc", "component", "members", *rest)


def _with_centrality(prefixes: DataFrame) -> DataFrame:
    """Adds how widely a document's prefix shingles are shared on average.  In a group of near copies the one with the fewest changes has the most."""
    entries = prefixes.select(F.explode("tokens").alias("token"), "doc")
    df = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    found = entries.join(df, "token").groupBy(F.col("doc").alias("d_doc")).agg(F.sum("df").alias("sum"))
    return prefixes.join(found, F.col("doc") == F.col("d_doc")).select("doc", "tokens", "n", "low", "half", (F.col("sum") / F.col("prefix")).alias("central"))


def _leader_pairs(entries: DataFrame, turn: int) -> DataFrame:
    """Every shingle's documents against one of its largest component, where there are more components than one.

    At first that is the most central one, so that a group meets few leaders;
    later chance has a say, so that documents still apart meet others.  A
    document takes the LEADERS that it has met most; what is left out here is
    left to the last round.
    """
    draw = F.xxhash64("doc", F.lit(turn))
    rank = F.struct("members", (F.col("central") * F.pmod(draw, F.lit(1 << 20)) if turn else F.col("central")).alias("central"), draw.alias("h"), "doc", "component", "n")
    lead = entries.groupBy("token").agg(F.max(rank).alias("l"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token", "l.*")
    lead = lead.select("token", F.col("doc").alias("a"), F.col("component").alias("c_a"), F.col("n").alias("n_a"))
    met = entries.join(lead, "token").where("component <> c_a AND 3 * n <= 4 * n_a AND 3 * n_a <= 4 * n")
    met = met.groupBy(F.col("doc").alias("b"), F.col("n").alias("n_b"), "a", "n_a").agg(F.count(F.lit(1)).alias("met"))
    per = met.groupBy("b", "n_b").agg(F.sum("met").alias("all"), F.slice(F.sort_array(F.collect_list(F.struct("met", "a", "n_a")), False), F.lit(1), F.lit(LEADERS)).alias("most"))
    return per.where("8 * all >= n_b").select("b", "n_b", F.explode("most").alias("m")).select("m.a", "b", "m.n_a", "n_b")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit per hashed shingle: what one signature has and another lacks, the sets differ by at least."""
    for batch in batches:
        sets = batch.column(1)
        bits = np.zeros((batch.num_rows, SIGNATURE), "u8")
        rows = np.repeat(np.arange(batch.num_rows), np.diff(sets.offsets.to_numpy()))
        place = mixed(sets.flatten().to_numpy().view("u8")) % np.uint64(64 * SIGNATURE)
        np.bitwise_or.at(bits, (rows, (place >> np.uint64(6)).astype("i8")), np.uint64(1) << (place & np.uint64(63)))
        offsets = np.arange(0, bits.size + 1, SIGNATURE, dtype="i4")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(bits.reshape(-1))))], ["doc", "bits"])


def _between(tokens: DataFrame) -> DataFrame:
    """``(token, df)`` of the shingles that more than one component has."""
    kinds = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return kinds.where("lo <> hi").select("token", "df")


def _still_open(tokens: DataFrame, part: str) -> DataFrame:
    """``(doc, component, n, half)`` of the documents that may link with another component by the part of their sets in ``tokens``: all but n/4 of it must be shared."""
    met = tokens.join(_between(tokens).select("token"), "token").groupBy("doc", "component", "n", "half", "low").agg(F.count(F.lit(1)).alias("met"))
    return met.where(F.col("met") >= F.greatest(F.lit(1), F.col(part) - F.expr("n div 4"))).select("doc", "component", "n", "low", "half")


def _open_sets(entries: DataFrame, segments: Segments) -> DataFrame:
    """``(doc, n, m, rarest, central)`` of the documents that may still link with another component.

    ``rarest`` are the ``m`` shingles of a whole set that other components have
    as well, by frequency.  Half of the sets tells most documents off before
    the rest is looked at; a set with few shingles in that half tells nothing.
    """
    some = materialize(_still_open(entries, "low"), "open")
    halves = segments.table.where(F.col("fragment") < FRAGMENTS // 2).join(some, "doc").select("doc", "component", "n", "low", "half", F.explode("segment").alias("token"))
    some = _still_open(halves, "half").where("half > n div 4").union(some.where("half <= n div 4").select("doc", "component", "n", "low", "half"))
    whole = materialize(segments.table.join(some, "doc").select("doc", "component", "n", "segment"), "open-segments")
    tokens = whole.select("doc", "component", "n", F.explode("segment").alias("token"))
    found = tokens.join(_between(tokens), "token").groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("rarest"), (F.sum("df") / F.col("n")).alias("central"))
    found = found.withColumn("m", F.size("rarest").cast("bigint")).where("4 * m >= 3 * n")
    return materialize(found.withColumn("rarest", F.col("rarest.token")), "open-sets")


def _pairs_apart(open_: DataFrame) -> DataFrame:
    """All pairs of different components that may link, by prefix, length, position and signature.

    Two sets that must share o shingles share one among the rarest m-o+1 of
    either; o follows from the sizes, so the larger set has a prefix for every
    band of smaller sizes.  A shingle at places i and j leaves at most
    min(i, j) shared ones before it, and as many as the shorter rest after it.
    """
    band = lambda n: F.floor(F.log(n) / math.log(BAND)).cast("int")
    own = ["doc", "component", "members", "n", "m"]

    def prefixes(df: DataFrame, overlap: Column) -> DataFrame:
        length = (F.col("m") - overlap + 1).cast("int")
        return df.withColumn("length", length).where("length > 0").select(*own, "band", F.posexplode(F.slice("rarest", F.lit(1), F.col("length"))).alias("pos", "token"))

    small = prefixes(open_.withColumn("band", band(F.col("n"))), F.ceil(F.col("n") * 6 / 7))
    least = F.greatest(F.ceil(F.pow(F.lit(BAND), "band") * (1 - 1e-6)), F.ceil(F.col("n") * 3 / 4))
    bands = open_.withColumn("band", F.explode(F.sequence(band(F.greatest(F.lit(1), F.ceil(F.col("n") * 3 / 4))), band(F.col("n")))))
    large = prefixes(bands, least_overlap(least, F.col("n")))
    # Within the largest component of a key nothing meets: its smaller sets meet the others' larger ones, and the others' smaller ones all.
    keys = small.groupBy("token", "band").agg(F.max(F.struct("members", "component"))["component"].alias("top"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    side = lambda df, name: df.select("token", "band", "half", *(F.col(c).alias(f"{c}_{name}") for c in ("doc", "component", "n", "m", "pos")))
    small = side(small.join(keys, ["token", "band"]).withColumn("half", F.explode(F.when(F.col("component") == F.col("top"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1))))), "a")
    large = large.join(keys, ["token", "band"]).where("lo <> component OR hi <> component")
    large = side(large.withColumn("half", F.when(F.col("component") == F.col("top"), 0).otherwise(1)), "b")
    apart = "component_a <> component_b AND (n_b > n_a OR n_b = n_a AND doc_b > doc_a) AND 3 * n_b <= 4 * n_a"
    reach = F.least("pos_a", "pos_b") + 1 + F.least(F.col("m_a") - 1 - F.col("pos_a"), F.col("m_b") - 1 - F.col("pos_b"))
    met = small.join(large, ["token", "band", "half"]).where(apart).where(reach >= least_overlap(F.col("n_a"), F.col("n_b")))
    met = met.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), "n_a", "n_b", "m_a", "m_b").distinct()
    signs = materialize(open_.select("doc", "rarest").mapInArrow(_signatures, "doc bigint, bits array<bigint>"), "signatures")
    for name in ("a", "b"):
        met = met.join(signs.select(F.col("doc").alias(name), F.col("bits").alias(f"bits_{name}")), name)
    lacks = lambda x, y: sum((F.bit_count(F.col(f"bits_{x}")[i].bitwiseAND(F.bitwise_not(F.col(f"bits_{y}")[i]))) for i in range(SIGNATURE)), F.lit(0))
    most = F.least(F.col("m_a") - lacks("a", "b"), F.col("m_b") - lacks("b", "a"))
    return met.where(most >= least_overlap(F.col("n_a"), F.col("n_b"))).select("a", "b", "n_a", "n_b")


def _several_texts(base: DataFrame, size: int, leader_rounds: int) -> DataFrame:
    """For tables in which an id has several texts: every text is a node, and an id joins its nodes."""
    rows = materialize(base.select("doc", F.when(F.col("doc").isNotNull(), F.xxhash64("doc", "text")).alias("node"), "text"), "nodes")
    found = materialize(jaccard_components(rows, "node", "text", size, leader_rounds).distinct(), "node-components").withColumnRenamed("node", "f_node")
    # Rows without an id stay for themselves; they need their number of shingles only.
    alone = rows.where("node IS NULL").mapInArrow(_null_profiles(size), "doc bigint, n_shingles bigint, component_id bigint")
    known = rows.where("node IS NOT NULL").select("doc", "node").join(found, F.col("node") == F.col("f_node")).select("doc", "n_shingles", F.col("component_id").alias("c"))
    first = known.groupBy("doc").agg(F.min("c").alias("a"))
    joined = components(known.select("doc", F.col("c").alias("b")).distinct().join(first, "doc").select("a", "b"))
    merged = known.join(joined, F.col("c") == F.col("node"), "left").select("doc", "n_shingles", F.coalesce("component", "c").alias("c"))
    names = merged.groupBy("c").agg(F.min("doc").alias("component_id"))
    return merged.join(names, "c").select("doc", "n_shingles", "component_id").union(alone)


def _null_profiles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(s) for s in shingle_sets(batch.column(2), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], ["doc", "n_shingles", "component_id"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, leader_rounds: int = LEADER_ROUNDS) -> DataFrame:
    """Link documents whose sets of ``size``-word shingles have a Jaccard similarity of 0.75 or more.

    Returns one row per input row: ``id_col``, ``n_shingles`` and
    ``component_id``, the smallest id reachable by links, itself included.
    Links are exact but for 64-bit hash collisions.

    A text with fewer words than ``size`` is one shingle; a null text or one
    without words has none and links with nothing.  Rows repeated with one id
    are one node with the links of all its rows.  A row with a null id links
    with nothing and has a null component.  An empty table gives an empty
    result; other columns are ignored.  Ids must be integers.
    """
    base = text_of(docs, id_col, text_col)
    kind = base.schema["doc"].dataType
    base = base.withColumn("doc", F.col("doc").cast("bigint"))
    profiles = materialize(base.mapInArrow(_profiles(size), "doc bigint, n bigint, prefix bigint, low bigint, half bigint, digest binary"), "profiles")
    some = profiles.where("n > 0 AND doc IS NOT NULL")
    # Equal sets are one class, represented by its smallest id.
    classes = some.groupBy("digest").agg(F.min("doc").alias("rep"))
    # A digest may hold a third of all rows; adaptive execution splits it.
    members = some.join(classes, "digest").select("doc", "rep", "n", "prefix", "low", "half")
    same = materialize(members.select("doc", "rep").distinct(), "classes")
    if same.groupBy("doc").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count():
        out = _several_texts(base, size, leader_rounds)
        return out.select(F.col("doc").cast(kind).alias(id_col), "n_shingles", F.col("component_id").cast(kind).alias("component_id"))
    reps = members.where("doc = rep").groupBy("doc").agg(F.max("n").alias("n"), F.max("prefix").alias("prefix"), F.max("low").alias("low"), F.max("half").alias("half"))
    labels = materialize(reps.withColumn("component", F.col("doc")), "labels")

    # Of a document that links at least three quarters are shared, so of its shingles up to FLOOR all but n/4.
    prefixes = shared_prefixes(base.where("doc IS NOT NULL"), size).groupBy("doc").agg(F.collect_set("token").alias("tokens"))
    prefixes = prefixes.join(labels, "doc").where(F.size("tokens") >= F.greatest(F.lit(1), F.col("low") - F.expr("n div 4")))
    prefixes = materialize(_with_centrality(materialize(prefixes.select("doc", "tokens", "n", "prefix", "low", "half"), "shared-prefixes")), "prefixes")
    segments = Segments(base.join(prefixes.select("doc"), "doc", "left_semi"), size)
    try:
        for turn in range(leader_rounds):
            labels = _merged(labels, segments.linked(_leader_pairs(_entries(prefixes, "tokens", labels), turn)))
        sets = _open_sets(_entries(prefixes, "tokens", labels), segments)
        if leader_rounds:
            labels = _merged(labels, segments.linked(_leader_pairs(_entries(sets, "rarest", labels), 0)))
        labels = _merged(labels, segments.linked(_pairs_apart(sets.join(_with_members(labels), "doc"))))
    finally:
        segments.drop()
    # Documents of a class follow their representative.
    named = same.groupBy("doc").agg(F.min("rep").alias("rep")).join(labels.select(F.col("doc").alias("r_doc"), "component"), F.col("rep") == F.col("r_doc"))
    found = named.select(F.col("doc").alias("c_doc"), "component")
    out = profiles.join(found, F.col("doc") == F.col("c_doc"), "left")
    return out.select(F.col("doc").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").cast(kind).alias("component_id"))
