"""Results that several later steps read, written once to storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a local master without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-meshlark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table: no step before it runs again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A table of a few rows whose size Catalyst knows, so that joins with it are broadcast by its own check."""
    kind = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [()] * len(kind)
    table = pa.table({f.name: pa.array(c, to_arrow_type(f.dataType)) for f, c in zip(kind, columns)})
    return spark.createDataFrame(table, kind)
