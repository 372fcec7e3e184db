"""Reading the corpus, and cutting lineage through shared storage."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts name it: the space and \t \n \v \f \r.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local master without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-meshlark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a result once to shared storage and read it back: lineage ends there and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of shared storage."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*written: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once no result needs it any more."""
    for df in written:
        remove(df.sparkSession, df.written_to)


def worker_keeps(key: tuple | None = None, make: Callable[[], object] | None = None) -> object:
    """What ``make`` gives, kept by this Python process from task to task under ``key``.

    Workers outlive operators, so one thing is kept at a time: what is there
    under another key is let go.  Without a key nothing is kept on.
    """
    kept = sys.modules.setdefault("meshlark_worker", types.ModuleType("meshlark_worker")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept.clear()
        if make is not None:
            kept[key] = make()
    return kept.get(key)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, text)`` alone, null texts as empty ones, so that no other column of the input can clash."""
    return df.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))



def other_id(doc: str = "doc", text: str = "text") -> Column:
    """What tells rows without an id apart: a hash of the text; null for rows with an id."""
    return F.when(F.col(doc).isNull(), F.xxhash64(text))
