"""Operators on event traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from runscope.joins import join_per_key
from runscope.session import written

KEYS_PER_TASK = 1_000_000


def roi_slice(
    events: DataFrame, is_start: Column, is_end: Column, order: str, broadcast_bytes: int = 0
) -> DataFrame:
    """events of a run from its first start marker to the first later end marker.

    Both markers belong to the slice. No start gives nothing; no end, all to the end of the
    run. Only marker rows are aggregated, and the events meet one row of bounds per run:
    no sort of a run, and nothing of it gathered in a task. On ``broadcast_bytes`` see
    :func:`join_per_key`.
    """
    position = F.col(order)
    starts = events.where(is_start).groupBy("run_id").agg(F.min(position).alias("roi_start"))
    if broadcast_bytes:
        starts = written(starts)  # used twice
    ends = (
        join_per_key(events.where(is_end), starts, "run_id", broadcast_bytes=broadcast_bytes)
        .where(position > F.col("roi_start"))
        .groupBy("run_id")
        .agg(F.min(position).alias("roi_end"))
    )
    bounds = starts.join(ends, "run_id", "left")
    inside = (position >= F.col("roi_start")) & (
        F.col("roi_end").isNull() | (position <= F.col("roi_end"))
    )
    bounded = join_per_key(events, bounds, "run_id", broadcast_bytes=broadcast_bytes)
    return bounded.where(inside).drop("roi_start", "roi_end")


def trace_histogram(trace: DataFrame, keys_per_task: int = KEYS_PER_TASK) -> DataFrame:
    """A4: frequency of each key in a run's ``trace(run_id, key)`` and its rank.

    Most frequent first, the smaller key first among equals. Runs of at most ``keys_per_task`` rows are dealt out once,
    by run, then counted and ranked where they are. Of a longer run, counting pre-aggregates before the shuffle; with at most so
    many distinct keys it is ranked by a window, with more by :func:`_rank_large`, to the same result.
    """
    by_rank = Window.partitionBy("run_id").orderBy(F.col("n").desc(), F.col("key"))

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("run_id", "key").agg(F.count("*").alias("n"))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(by_rank).cast("bigint"))

    lengths = trace.groupBy("run_id").agg(F.count("*").alias("rows"))
    long = written(lengths.where(F.col("rows") > keys_per_task).select("run_id"))
    if long.isEmpty():
        return ranked(counted(trace.select("run_id", "key").repartition("run_id")))
    short = trace.join(F.broadcast(long), F.equal_null(trace["run_id"], long["run_id"]), "left_anti")
    known = ranked(counted(short.select("run_id", "key").repartition("run_id")))
    longer = trace.join(F.broadcast(long), F.equal_null(trace["run_id"], long["run_id"]), "left_semi")
    counts = written(counted(longer))
    sizes = counts.groupBy("run_id").agg(F.count("*").alias("keys"))
    large = sizes.where(F.col("keys") > keys_per_task).select("run_id")
    if large.isEmpty():
        return known.unionByName(ranked(counts))
    return known.unionByName(ranked(join_per_key(counts, large, "run_id", "left_anti"))).unionByName(
        _rank_large(join_per_key(counts, large, "run_id", "left_semi"))
    )


def _rank_large(counts: DataFrame) -> DataFrame:
    """Ranks within runs of any size, each run spread over many tasks.

    A range partitioning by (run, rank order) cuts runs into consecutive pieces. The cut is
    written out, so that all later steps see the same one. A rank is then the place within
    the piece plus the rows in the run's earlier pieces.
    """
    pieces = written(
        counts.repartitionByRange("run_id", F.col("n").desc(), "key").withColumn(
            "piece", F.spark_partition_id()
        )
    )
    earlier = Window.partitionBy("run_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy("run_id", "piece")
        .agg(F.count("*").alias("rows"))
        .select("run_id", "piece", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    )
    in_piece = Window.partitionBy("run_id", "piece").orderBy(F.col("n").desc(), F.col("key"))
    return (
        pieces.withColumn("place", F.row_number().over(in_piece))
        .join(offsets, ["run_id", "piece"])
        .select("run_id", "key", "n", (F.col("before") + F.col("place")).alias("rank"))
    )
