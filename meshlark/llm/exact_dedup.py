"""Exact deduplication by content-defined chunk recipes, in DataFrame functions alone.

Every text is cut where its own content says so, each chunk gets a short
identifier, and the ordered list of identifiers -- the recipe -- stands for the
text from then on.  Chunk texts move once, after map-side deduplication, to
prove that an identifier names one text only; long documents never move whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

#: A chunk ends at a blank with certain characters around it, which about one place in 240 has in prose; it
#: has 256 characters at least and 4096 at most.  Where the content cuts, two texts fall into step again after a change.
CHUNKS = r"(?s).{256,4092}?[aeiou][dgmkxz.;|0-4]\s(?=[cfimpuvwT-Z0-9])|.{1,4096}"


def chunk_digest(chunk: Column) -> Column:
    """16 bytes that name a chunk, until two texts are found to share them."""
    return F.unhex(F.md5(chunk))


def chunks_of(text: Column, pattern: str = CHUNKS) -> Column:
    """The content-defined chunks of a text, in order; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def clashing_ids(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Identifiers ``cid`` that more than one chunk text has.  Copies of a chunk meet on the map side first."""
    chunk = docs.select(F.explode(chunks_of(F.col("text"))).alias("chunk"))
    distinct = chunk.select(digest(F.col("chunk")).alias("cid"), "chunk").distinct()
    return distinct.groupBy("cid").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("cid")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = chunk_digest
) -> DataFrame:
    """Group documents of identical text; the one with the largest id of a group stays.

    Returns one row per input row: ``id_col``, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256`` and ``n_chunks``.

    Null texts equal empty ones.  A null id loses against any other and stays
    only where its group has no other.  Rows repeated with the same id and text
    are one document: each counts in ``group_size`` and all share ``kept``.  An
    empty table gives an empty result; other columns are ignored.
    """
    base = text_of(docs, id_col, text_col)
    recipe = base.select(
        "doc", F.transform(chunks_of(F.col("text")), digest).alias("recipe"), F.sha2("text", 256).alias("text_sha256")
    ).withColumn("clash_text", F.lit(None).cast("string"))
    # A handful of rows at most: with 128-bit digests normally none.
    clash = materialize(clashing_ids(base, digest), "clashing-chunks")
    if clash.limit(1).count():
        # Texts holding a chunk whose identifier is shared are told apart by the texts themselves.
        ids = F.transform(chunks_of(F.col("text")), digest)
        marked = (
            base.select("doc", "text", ids.alias("recipe"), F.explode_outer(ids).alias("cid"))
            .join(clash.withColumn("hit", F.lit(True)), "cid", "left")
            .groupBy("doc", "text", "recipe")
            .agg(F.max("hit").alias("hit"), F.count_if(F.col("cid").isNotNull()).alias("seen"))
        )
        # The rows of one document had been exploded together; as many come back as it had.
        copies = F.when(F.size("recipe") == 0, 1).otherwise((F.col("seen") / F.greatest(F.size("recipe"), F.lit(1))).cast("int"))
        recipe = marked.select(
            "doc", "recipe", F.sha2("text", 256).alias("text_sha256"), F.when(F.col("hit"), F.col("text")).alias("clash_text"),
            F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
        ).drop("copy")
    groups = recipe.groupBy(F.col("recipe").alias("g_recipe"), F.col("clash_text").alias("g_text")).agg(
        F.max("doc").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    same = (F.col("recipe") == F.col("g_recipe")) & F.col("clash_text").eqNullSafe(F.col("g_text"))
    # The hot side of this join is split by adaptive execution; the other has one row per group.
    return recipe.join(groups, same).select(
        F.col("doc").alias(id_col), "keep_id", "group_size", F.col("doc").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256", F.size("recipe").alias("n_chunks"),
    )
