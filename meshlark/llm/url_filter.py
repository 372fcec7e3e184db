"""URL filters by a temporal list join.

A list is a log of dated entries: a domain was added to a category, or removed.
Per domain and category they become validity intervals, and an as-of join
evaluates every capture against what was active when it was fetched.  Captures
are dealt out by domain and span of time, and intervals go to those spans in
which their domain was captured at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

#: Seconds that a span of time has in the as-of join.
SPAN = 30 * 86_400


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, without user, port and final dot; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    return ascii_lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated entries ``(domain, category, at, action)`` to ``(domain, category, valid_from, valid_to)``.

    ``action`` is ``add`` or ``remove``, other actions and entries without a
    domain or date are ignored.  Of entries at one time for one domain and
    category the removal wins.  Adding what is listed, or removing what is not,
    changes nothing.  An interval holds from its start until before its end,
    which is null while the listing lasts.
    """
    dated = entries.where("domain IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')").groupBy("domain", F.coalesce("category", F.lit("")).alias("category"), "at").agg(F.min(F.when(F.col("action") == "remove", 0).otherwise(1)).alias("listed"))
    by = Window.partitionBy("domain", "category").orderBy("at")
    changes = dated.withColumn("before", F.lag("listed", 1, 0).over(by)).where("listed <> before")
    return changes.withColumn("valid_to", F.lead("at").over(by)).where("listed = 1").select("domain", "category", F.col("at").alias("valid_from"), "valid_to")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Evaluate every capture against the list entries active at its fetch time.

    An entry for a domain covers its subdomains, however many labels they have.
    Returns one row per input row: ``id_col``, ``host``, ``blocked``, ``matched_domain`` (the most specific
    one) and ``categories`` (sorted, comma-joined).

    URLs may be of any length.  A null or malformed URL has an empty host and is not blocked, nor is a
    capture without a fetch time.  Times of captures and entries are read as
    timestamps and may lie anywhere, as wrong clocks have them.  Rows repeated with one id are evaluated each
    (their categories meet if the rows are equal); ids may be null.  Empty
    captures give an empty result; other columns are ignored.
    """
    pages = captures.select(F.col(id_col).alias("page"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.col(time_col).cast("timestamp").alias("fetched"))
    entries = entries.withColumn("at", F.col("at").cast("timestamp"))
    # Captures of one host at one time share their answer, which shrinks a host with a third of all rows.
    asked = pages.where("host <> '' AND fetched IS NOT NULL").select("host", "fetched").distinct()
    # A row per parent domain, the host itself included; each is cut after the explode, so that no row holds all of a long host's.
    parents = asked.select("host", "fetched", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))).alias("labels"))
    parents = parents.select("host", "fetched", F.expr("substring_index(host, '.', -labels)").alias("domain"))
    span = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / SPAN)
    parents = parents.withColumn("span", span(F.col("fetched")))
    # Intervals are kept for the spans in which their domain was captured, so that rows follow captures and entries, not the calendar.
    within = (span(F.col("valid_from")) <= F.col("span")) & (F.col("valid_to").isNull() | (span(F.col("valid_to")) >= F.col("span")))
    listed = parents.select("domain", "span").distinct().join(validity_intervals(entries), "domain").where(within)
    # The hot side is split by adaptive execution.
    hits = parents.join(listed, ["domain", "span"]).where("valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to)")
    answers = hits.groupBy("host", "fetched").agg(
        F.max(F.struct(F.length("domain").alias("length"), "domain")).alias("best"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")
    ).select(F.col("host").alias("a_host"), F.col("fetched").alias("a_fetched"), F.col("best.domain").alias("matched_domain"), "categories")
    joined = pages.join(answers, (F.col("host") == F.col("a_host")) & (F.col("fetched") == F.col("a_fetched")), "left")
    return joined.select(F.col("page").alias(id_col), "host", F.col("matched_domain").isNotNull().alias("blocked"), "matched_domain", "categories")
