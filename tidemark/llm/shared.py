"""The folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; this also cuts its lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent_if_small(df: DataFrame, name: str, rows: int = 1_000_000) -> DataFrame:
    """``df`` (rows of an id or so) written, counted, and sent to all tasks of a join if it has at most ``rows``."""
    out = written(df, name)
    return F.broadcast(out) if out.limit(rows + 1).count() <= rows else out
