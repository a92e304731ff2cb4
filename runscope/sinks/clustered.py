"""Raw samples stored by series, so that analysing them again shuffles nothing.

Samples are bucketed by (run, counter) and sorted within a bucket. Whatever groups by that key, final values and
predecessors alike, then reads each bucket where it lies. What is known per run is broadcast if it is small.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from runscope.operators.series import PREVIOUS

KEY = ("run_id", "counter")
_ORDER = (*KEY, "sample_idx")


def write_clustered(samples: DataFrame, path: str, buckets: int = 0) -> DataFrame:
    """Write ``samples(run_id, sample_idx, cycles, counter, value)`` below ``path`` and return them as stored.

    One shuffle, the last: it deals the rows out as the buckets want them, so each bucket is one sorted file. A series is
    never cut; a run of many counters is spread over as many buckets.
    """
    spark = samples.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"clustered_{uuid.uuid4().hex}"
    rows = samples.drop(*PREVIOUS).repartition(buckets, *KEY)
    rows.write.format("parquet").bucketBy(buckets, *KEY).sortBy(*_ORDER).option("path", path).saveAsTable(table)
    return spark.table(table)


def open_clustered(spark: SparkSession, path: str, buckets: int, run_type: str = "string") -> DataFrame:
    """What another session stored: its buckets must be told, as the files don't."""
    table = f"clustered_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {table} (run_id {run_type}, sample_idx BIGINT, cycles BIGINT, counter STRING, value BIGINT) USING parquet"
        f" CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(_ORDER)}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def with_previous_stored(samples: DataFrame) -> DataFrame:
    """Add what came before each sample of a stored table, as :func:`runscope.operators.series.steps` has it."""
    before = Window.partitionBy(*KEY).orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(F.col("value").isNotNull(), F.struct("value", F.col("sample_idx").alias("at"))), ignorenulls=True).over(before)
    return samples.withColumn("known", known).select(
        "run_id", "sample_idx", "cycles", "counter", "value", F.col("known.value").alias("previous"), F.col("known.at").alias("previous_at")
    )
