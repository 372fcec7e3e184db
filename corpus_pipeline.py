"""A corpus pipeline out of the operators in ``meshlark.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.

Every row is judged by its own text, whether its id is null or repeated.  Rows
that are equal in id and text are one document for ``near_duplicates``; the
other stages treat them alike.  Texts may be null, empty or of any length,
tables may be empty, and other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm.common import materialize, table
from meshlark.llm.decontaminate import decontaminate
from meshlark.llm.jaccard import jaccard_components
from meshlark.llm.langid import fit, predict
from meshlark.llm.line_dedup import line_dedup
from meshlark.llm.packing import pack

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or far from every language, go.  If no row has a language to learn from, all go."""
    return predict(docs, fit(docs)).where(~F.col("rejected")).select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in one of them only.  A document stays, even without lines."""
    kept = line_dedup(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("bigint").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest id stays; a null id is larger than any other.

    Of rows equal in id and text one stays.  Rows with one id and different
    texts are documents of their own.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if not ids.where("n > 1 OR doc_id IS NULL").limit(1).count():
        gone = jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    rows = docs.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("row"))
    rows = rows.select("doc_id", "text", "row.*", F.monotonically_increasing_id().alias("node"))
    rows = materialize(rows, "distinct-rows")  # which fixes the numbers
    linked = jaccard_components(rows, "node").select(F.col("node").alias("l_node"), "component_id")
    named = rows.select("node", "doc_id").join(linked, F.col("node") == F.col("l_node"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))["node"]
    stay = named.groupBy("component_id").agg(first.alias("node")).select("node")
    return rows.join(stay, "node", "left_semi").select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rest = [c for c in COLUMNS if c != "doc_id"]
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=rest).where(~F.col("contaminated")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("repeated_lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("packed", packed),
]

#: Language models and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
