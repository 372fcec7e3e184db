"""Secret scan with corpus-wide ownership, in DataFrame functions alone.

Candidate spans come from the patterns below.  The digest of every candidate is
then counted over the whole corpus by distinct owners and repositories: what
many owners share is a copied example, what one owner alone has looks live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Group 2 is the secret; a match whose group 2 is shorter than 8 is dropped, but still takes its place in the text.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs; the least length is part of the pattern, as shorter runs can hide no other match.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Opaque runs outside the other kinds: a span only if they have a letter and a digit and belong to few owners.
OPAQUE = r"[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "owned")
BLOCK = 256


def running_sums(values: Column) -> Column:
    """Running sums of an array, block by block, so that no array grows by one element a million times."""

    def sums(items: Column, start: Column) -> Column:
        none = F.lit(None).cast("array<bigint>")
        empty = F.coalesce(none, F.array().cast("array<bigint>"))
        return F.aggregate(items, empty, lambda out, x: F.concat(out, F.array(x + F.coalesce(F.try_element_at(out, F.lit(-1)), start))))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(values, i + 1, F.lit(BLOCK)))
    zero = F.lit(0).cast("bigint")
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + x))
    ends = sums(totals, zero)
    return F.flatten(F.zip_with(blocks, F.zip_with(ends, totals, lambda e, t: e - t), sums))


def matches(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """``array<struct<start, kind, stop, value>>`` of the kept matches, positions in code points."""
    empty = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,value:string>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: (F.char_length(h) + F.char_length(g)).cast("bigint"))
        spans = F.zip_with(hits, running_sums(steps), lambda h, stop: F.struct(
            (stop - F.char_length(h)).alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), value(h).alias("value")))
        return F.filter(spans, lambda s: keep(s["value"])).cast("array<struct<start:bigint,kind:int,stop:bigint,value:string>>")

    # Most texts have no match; only the others are split for positions.
    return F.when(F.size(hits) > 0, placed(hits)).otherwise(empty)


def candidate_spans(text: Column) -> Column:
    """All candidates of a text by start, then kind; opaque runs only where no other candidate overlaps them."""
    anything = lambda v: F.lit(True)
    itself = lambda h: h
    base = F.concat(
        matches(text, ASSIGN, 0, lambda v: F.char_length(v) >= 8, lambda h: F.regexp_extract(h, ASSIGN, 2)),
        matches(text, ACCESS, 1, anything, itself),
        matches(text, HEX, 2, anything, itself),
    )
    opaque = matches(text, OPAQUE, 3, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"), itself)
    return F.struct(base.alias("base"), opaque.alias("opaque"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    text = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")))
    return F.concat_ws(",", text)


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None,
    max_owners: int = 1, example_owners: int = 3,
) -> DataFrame:
    """Find secrets in every whole text and tell live-looking ones from copied examples.

    A document is a repository of its own unless ``repo_col`` names one.  A
    secret with at most ``max_owners`` owners is live-looking, one with
    ``example_owners`` or more, in as many repositories, is an example: a
    repository that names several owners is one copy.  Returns one row per
    input row: ``id_col``, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256``, ``spans`` (base spans, and owned ones that the count adds),
    ``found`` (array of kind, start, stop, sha256, owners, repositories),
    ``n_live``, ``n_example``, and ``most_owners`` and ``most_repositories``
    that any of its secrets has.

    Null text is empty; texts may be of any length; a null owner is no owner, so
    a secret with none counts as live-looking.  Rows repeated with one id are
    scanned each, and count as one repository, as do all rows without an id.  An
    empty table gives an empty result; other columns are ignored.
    """
    repo = F.col(repo_col or id_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(owner_col).cast("string").alias("owner"), repo.alias("repo"))
    # A row is known by its id and a hash of its text, so that rows without an id don't gather anywhere.
    scanned = rows.select("doc", F.xxhash64("text").alias("h"), "owner", "repo", candidate_spans(F.col("text")).alias("s"))
    base = F.array_sort("s.base")
    outside = F.filter("s.opaque", lambda o: ~F.exists("s.base", lambda b: (b["start"] < o["stop"]) & (o["start"] < b["stop"])))
    hashed = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["kind"], s["stop"], F.sha2(s["value"], 256).alias("secret")))
    # One row per document without its text: the corpus is scanned once.
    found = materialize(scanned.select("doc", "h", "owner", "repo", hashed(base).alias("base"), hashed(outside).alias("opaque")), "secret-candidates")

    uses = found.select("doc", "h", "owner", "repo", F.explode(F.concat("base", "opaque")).alias("s")).select("doc", "h", "owner", "repo", "s.secret").distinct()
    freq = uses.groupBy("secret").agg(F.count_distinct("owner").alias("owners"), F.count_distinct(F.coalesce("repo", F.lit(""))).alias("repos"))
    # A document's secrets with their counts; the hot side of the join is split by adaptive execution.
    counts = uses.select("doc", "h", "secret").distinct().join(freq, "secret").groupBy("doc", "h").agg(
        F.map_from_entries(F.collect_list(F.struct("secret", F.struct("owners", "repos")))).alias("counts")
    ).withColumnsRenamed({"doc": "c_doc", "h": "c_h"})
    joined = found.join(counts, F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("h") == F.col("c_h")), "left")
    owners = lambda s: F.element_at("counts", s["secret"])["owners"]
    repos = lambda s: F.element_at("counts", s["secret"])["repos"]
    most = lambda of: F.coalesce(F.array_max(F.transform("all", of)), F.lit(0)).cast("bigint")
    owned = F.filter("opaque", lambda s: owners(s) <= max_owners)
    spans = joined.select("doc", "base", "counts", F.array_sort(F.concat("base", owned)).alias("all"))
    kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    names = F.array(*map(F.lit, KINDS))
    return spans.select(
        F.col("doc").alias(id_col), kind(0).alias("n_assign"), kind(1).alias("n_access"), kind(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"),
        F.transform("all", lambda s: F.struct(
            F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["secret"].alias("sha256"),
            owners(s).alias("owners"), repos(s).alias("repositories"))).alias("found"),
        F.size(F.filter("all", lambda s: owners(s) <= max_owners)).cast("bigint").alias("n_live"),
        F.size(F.filter("all", lambda s: (owners(s) >= example_owners) & (repos(s) >= example_owners))).cast("bigint").alias("n_example"),
        most(owners).alias("most_owners"), most(repos).alias("most_repositories"),
    )
