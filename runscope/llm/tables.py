"""Helpers on DataFrames that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runscope.session import fresh_path

#: A side is broadcast if its written Parquet files have at most so many bytes; else it is shuffled.
BROADCAST_BYTES = 4 << 20


def written(df: DataFrame, purpose: str, broadcast_bytes: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts its lineage.

    With ``broadcast_bytes``, the files are measured, and a table within that is broadcast in joins.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, purpose)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if not broadcast_bytes:
        return table
    files = spark.read.format("binaryFile").load(f"{path}/*.parquet").agg(F.sum("length"))  # lengths only
    return F.broadcast(table) if (files.first()[0] or 0) <= broadcast_bytes else table


def measured(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written, and broadcast in joins if it is small."""
    return written(df, purpose, BROADCAST_BYTES)


def without(docs: DataFrame, ids: DataFrame, purpose: str) -> DataFrame:
    """``docs`` whose ``doc_id`` is not in ``ids(doc_id)``; those without an id stay."""
    return docs.join(measured(ids.select("doc_id").distinct(), purpose), "doc_id", "left_anti").select(docs.columns)
