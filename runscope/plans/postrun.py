"""Analysis of finished runs: from their files to the results tree, all runs in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from runscope.formats import COUNTER_FILE, CYCLES, LOG_FILE, MPKI_COUNTERS
from runscope.functions.labels import hue_split
from runscope.functions.rates import cycles_to_seconds
from runscope.joins import BROADCAST_BYTES
from runscope.operators.metrics import (
    counter_final,
    instruction_counts,
    metric_merge,
    mpki_final,
    results_pivot,
    uart_last_wins,
)
from runscope.operators.runs import latest_pointer, run_enrich, run_summary
from runscope.operators.series import delta_table, raw_table, warmup_drop
from runscope.session import job, written
from runscope.sinks.results import TREE, with_labels, write_table
from runscope.sinks.snapshots import merge_rows
from runscope.sources.counters import WHOLE_FILE_BYTES, read_counter_samples
from runscope.sources.logs import LATEST, read_log_tokens


#: What a pointer to the newest run is kept for.
LATEST_BY = ("series", "name", "runtime_config")


def merged_metrics(log_metrics: DataFrame, samples: DataFrame) -> DataFrame:
    """Metrics per run from the log and from samples past the warm-up; counters win."""
    return metric_merge(log_metrics, counter_final(samples))


def mpki_report(tokens: DataFrame, samples: DataFrame) -> DataFrame:
    """Misses per thousand instructions per run, from raw samples and log tokens."""
    return mpki_final(merged_metrics(uart_last_wins(tokens), warmup_drop(samples)))


def run_results(
    log_metrics: DataFrame, samples: DataFrame, names: Sequence[str],
    counters: Sequence[str] = MPKI_COUNTERS, every: bool = False,
) -> DataFrame:
    """One wide row per run: the listed metrics, the ratios and the simulated seconds; ``every``: all metrics beside them."""
    wide = results_pivot(merged_metrics(log_metrics, samples), [*names, CYCLES], counters, every)
    return wide.withColumn("sim_seconds", cycles_to_seconds(F.col(f"`{CYCLES}`")))


def analyse(
    spark: SparkSession,
    run_dirs: str,
    results_root: str,
    names: Sequence[str],
    timing: DataFrame,
    labels: DataFrame,
    artifacts: DataFrame,
    descriptions: DataFrame,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
) -> None:
    """Read the runs below ``run_dirs`` (a glob of directories) and write the results tree.

    Tables by (series, name, config), each replacing what the tree had of those: ``results``, a wide row per run with
    the metrics ``names`` and, in ``every_metric``, all it has; ``metrics``, all metrics in the long form; ``raw`` and ``deltas``;
    ``summaries``, a text per run. ``latest``: the newest run by end time of each series, name
    and runtime configuration, of all analyses so far; runs without an end time count as the oldest. ``unlabelled``: what was read of runs that ``labels`` doesn't
    have, replaced by each job.

    The side tables are those of :func:`runscope.operators.runs.run_enrich`; ``labels`` also has
    ``series``. Runs without a log or counter file have NULLs. Every file is parsed once, into the
    shared folder; all tables are made from that and never from the tree, and it is deleted
    at the end. Two directories of one name are an error, as runs go by that name.
    """
    with job(spark):
        places = written(labels.select("run_id", *TREE), "places")
        logs = read_log_tokens(spark, run_dirs, name=LOG_FILE)
        log_metrics = written(uart_last_wins(logs), "log-metrics")
        parsed = read_counter_samples(spark, run_dirs, whole_file_bytes, name=COUNTER_FILE, with_steps=True)
        samples = written(warmup_drop(parsed), "samples")
        _check_names(spark, run_dirs)

        def save(table: DataFrame, name: str) -> None:
            """Write by place, and empty the places of this job that have no row."""
            write_table(table, f"{results_root}/{name}", places=places)

        raw = written(with_labels(raw_table(samples), places, BROADCAST_BYTES), "raw")
        save(raw, "raw")
        per_run = places.join(instruction_counts(log_metrics), "run_id", "left")
        deltas = written(delta_table(samples, per_run, how="inner", broadcast_bytes=BROADCAST_BYTES), "deltas")
        save(deltas, "deltas")
        merged = written(merged_metrics(log_metrics, samples), "metrics")
        metric_rows = merged.withColumnRenamed("name", "metric").drop("overridden")
        save(metric_rows.join(places, "run_id"), "metrics")

        # a run that left neither metrics nor samples has a row all the same
        results = labels.select("run_id").join(run_results(log_metrics, samples, names, every=True), "run_id", "left")
        enriched = written(
            run_enrich(results, timing, labels, artifacts, descriptions).join(labels.select("run_id", "series"), "run_id"), "results"
        )
        save(enriched, "results")
        save(run_summary(enriched).join(places, "run_id"), "summaries")
        runtime = hue_split(F.col("config"))[1].alias("runtime_config")
        ended = enriched.select("series", "name", runtime, "config", "run_id", "dir", F.col("timestamp").alias("ended_at"))
        # an analysis of older runs must not move a pointer back
        merge_rows(ended, f"{results_root}/latest", LATEST_BY, lambda rows: latest_pointer(rows, LATEST_BY, "ended_at"))
        unknown = merged.join(places.select("run_id"), "run_id", "left_anti")
        unknown.select("run_id", "name", "value", "src").write.mode("overwrite").parquet(f"{results_root}/unlabelled")


def _check_names(spark: SparkSession, run_dirs: str) -> None:
    """Fail if two directories have the same name; only the listing is read."""
    folder = F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{{{LOG_FILE},{COUNTER_FILE}}}").load(run_dirs)
    folders = files.select(folder.alias("folder")).distinct().select(F.substring_index("folder", "/", -1).alias("run_id"))
    twice = folders.groupBy("run_id").count().where(f"count > 1 and run_id <> '{LATEST}'").first()
    if twice is not None:
        raise ValueError(f"more than one directory is named {twice.run_id}")
