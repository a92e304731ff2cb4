"""Pick up the files of newly finished runs, each exactly once.

A run is analysed when it ends, so its directory should appear as a whole (be moved into
place). Each call handles the runs that came since the last one and returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from runscope.formats import COUNTER_FILE, LOG_FILE
from runscope.operators.metrics import uart_last_wins
from runscope.operators.series import warmup_drop
from runscope.session import job, written
from runscope.sources.counters import counter_scan_lines
from runscope.sources.logs import is_run, line_columns, scan_log_lines


def _drain(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Parse all that is new into ``target/query=<id>/batch=<id>``; a repeated batch replaces its folder.

    The query's id comes from the checkpoint, so another checkpoint writes beside, not over it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        with job(spark):
            parse(batch).write.mode("overwrite").parquet(f"{target}/query={query_id}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def collect_log_metrics(spark: SparkSession, run_dirs: str, target: str, checkpoint: str) -> None:
    """Last value of each log metric of each new run, into ``target``.

    A file belongs to one batch with all its lines, so a batch's last value is the run's.
    """
    lines = spark.readStream.text(f"{run_dirs}/{LOG_FILE}").select(*line_columns()).where(is_run("path"))
    _drain(lines, lambda batch: uart_last_wins(scan_log_lines(batch)), target, checkpoint)


def collect_samples(spark: SparkSession, run_dirs: str, target: str, checkpoint: str) -> None:
    """Counter samples past the warm-up of each new run, into ``target``.

    Files are read by line, so one of any size is spread over tasks. A batch's lines are written
    first, as their numbers must not change while they are used.
    """
    lines = spark.readStream.text(f"{run_dirs}/{COUNTER_FILE}").select(*line_columns()).where(is_run("path"))

    def parse(batch: DataFrame) -> DataFrame:
        return warmup_drop(counter_scan_lines(written(batch.withColumn("seq", F.monotonically_increasing_id()), "lines")))

    _drain(lines, parse, target, checkpoint)
