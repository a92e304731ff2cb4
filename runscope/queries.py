"""One query per operator over the given tables: ``name -> callable(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from runscope import fixtures as fx
from runscope.formats import CYCLES
from runscope.functions import labels as lab
from runscope.functions.rates import cycles_to_seconds, host_walltime
from runscope.functions.text import run_name_valid
from runscope.joins import BROADCAST_BYTES
from runscope.operators import configs, metrics, runs, series, traces
from runscope.plans import postrun
from runscope.session import fresh_path, written
from runscope.sinks import results as sink
from runscope.sinks.clustered import with_previous_stored, write_clustered
from runscope.sinks.files import write_run_files
from runscope.sinks.snapshots import merge_rows, read_current
from runscope.sources import counters, files, logs

#: Axes of a sweep.
AXES = ("program", "run_config", "fpga", "runtime")

Query = Callable[[SparkSession, str], DataFrame]


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return logs.uart_scan(fx.log_files(spark, d))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return series.warmup_drop(fx.counter_samples(spark, d))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return series.warmup_drop(series.steps(fx.counter_lines(spark, d)))


def _log_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.uart_last_wins(_tokens(spark, d))


def _instructions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.instruction_counts(_log_metrics(spark, d))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return postrun.merged_metrics(_log_metrics(spark, d), _samples(spark, d))


def _results(spark: SparkSession, d: str) -> DataFrame:
    return postrun.run_results(_log_metrics(spark, d), _samples(spark, d), fx.LOG_METRICS + fx.COUNTERS[:4])


def _plain(df: DataFrame) -> DataFrame:
    """The cycle counter's column under a name that needs no quoting."""
    return df.withColumnRenamed(CYCLES, "cycles")


# --- sources --------------------------------------------------------------------------

def uart_scan(spark, d):
    return _tokens(spark, d)


def counter_scan(spark, d):
    return counters.counter_scan(fx.counter_files(spark, d))


def description_scan(spark, d):
    return logs.description_scan(fx.documents_as_files(spark, d))


def artifact_md5(spark, d):
    return files.artifact_md5(fx.documents_as_files(spark, d))


def run_catalog(spark, d):
    listed = fx.run_manifest(spark, d).where(run_name_valid(F.col("run_name")))
    stamped = F.concat("run_name", lab.run_stamp(F.col("written_at"), "run"))
    return files.run_catalog(
        listed.select(
            F.concat(F.lit("logs/"), stamped, F.lit("/uartlog")).alias("path"),
            F.col("run_id").alias("length"),
            F.col("written_at").alias("modificationTime"),
        )
    )


def submission_parse(spark, d):
    return logs.submission_parse(fx.submission_log(spark, d))


# --- sinks ----------------------------------------------------------------------------

def _labelled_results(spark, d):
    return sink.with_labels(_plain(_results(spark, d)), fx.document_labels(spark, d))


def results_sink(spark, d):
    table = written(_labelled_results(spark, d))  # written twice, computed once
    root = fresh_path(spark, "results")
    sink.write_results(table, root)
    # one series runs again: only its partitions are replaced
    sink.write_results(table.where(F.col("series") == "src1").withColumn("click", F.lit(-1.0)), root)
    return sink.read_tree(spark, root, table)


def raw_series_sink(spark, d):
    table = sink.with_labels(series.raw_table(_samples(spark, d)), fx.document_labels(spark, d), BROADCAST_BYTES)
    root = fresh_path(spark, "raw")
    sink.write_raw(table, root)
    return sink.read_tree(spark, root, table)


def delta_series_sink(spark, d):
    labels = fx.document_labels(spark, d).select("run_id", *sink.TREE)
    per_run = labels.join(_instructions(spark, d), "run_id", "left")
    table = series.delta_table(_steps(spark, d), per_run, how="inner", broadcast_bytes=BROADCAST_BYTES)
    root = fresh_path(spark, "deltas")
    sink.write_deltas(table, root)
    return sink.read_tree(spark, root, table)


# --- projections ----------------------------------------------------------------------

def _hue():
    return lab.hue_compose(F.col("benchmark"), F.col("runtime"), F.col("run_config"), F.col("fpga"))


def hue_split(spark, d):
    return fx.run_manifest(spark, d).select("run_id", *lab.hue_split(_hue()))


def hue_compose(spark, d):
    return fx.run_manifest(spark, d).select("run_id", _hue().alias("hue"))


def metric_name(spark, d):
    token = F.regexp_extract("value", "(YUKON_[A-Z_]+)=", 1)
    return fx.log_lines(spark, d).select(
        "run_id",
        "line_no",
        lab.metric_name(token).alias("name"),
        lab.metric_name(token, "full").alias("full_name"),
        F.regexp_extract("value", "=([0-9]+)", 1).cast("double").alias("value"),
    )


def cycles_to_seconds_(spark, d):
    return _samples(spark, d).where(F.col("counter") == CYCLES).select(
        "run_id", "sample_idx", cycles_to_seconds(F.col("value")).alias("seconds")
    )


def mpki_final(spark, d):
    return metrics.mpki_final(_merged(spark, d))


def mpki_series(spark, d):
    return series.mpki_series(
        _samples(spark, d), _instructions(spark, d), broadcast_bytes=BROADCAST_BYTES
    )


def host_walltime_(spark, d):
    return fx.run_timing(spark, d).select(
        "run_id", host_walltime(F.col("started_at"), F.col("ended_at")).alias("host_walltime")
    )


def run_stamp(spark, d):
    stamps = {style: lab.run_stamp(F.col("written_at"), style) for style in lab.STAMP_STYLES}
    return fx.run_manifest(spark, d).select(
        "run_id",
        *[stamp.alias(f"{style}_stamp") for style, stamp in stamps.items()],
        *[lab.parse_stamp(stamp, style).alias(f"{style}_parsed") for style, stamp in stamps.items()],
    )


def command_text(spark, d):
    words = F.split("cmd", " ")
    return fx.run_manifest(spark, d).select(
        "run_id",
        lab.command_text(F.col("cmd")).alias("scalar"),
        lab.command_text(words, " ").alias("spaced"),
        lab.command_text(words, " ; ").alias("chained"),
        lab.command_text(words, "\n").alias("script"),
    )


def job_kind(spark, d):
    return fx.run_manifest(spark, d).select("run_id", *lab.job_kind(F.col("cmd"), F.col("run_name")))


def result_path(spark, d):
    jobs = logs.submission_parse(fx.submission_log(spark, d))
    return fx.run_manifest(spark, d).join(jobs, "run_id").select(
        "run_id",
        lab.result_path(F.col("fpga"), F.col("benchmark"), _hue()).alias("result_dir"),
        lab.log_path(F.lit("out/jobs/%j.log"), F.col("job_id")).alias("log"),
    )


def run_id_assign(spark, d):
    """What must hold of the random ids, per run: form, no other run's, the same when read again."""
    assigned = runs.run_id_assign(fx.run_manifest(spark, d).select(F.col("run_id").alias("run_key")))
    uuid4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    uses = assigned.groupBy("run_id").agg(F.count("*").alias("uses"))
    again = assigned.select("run_key", F.col("run_id").alias("second"))
    return assigned.join(uses, "run_id").join(again, "run_key").select(
        "run_key",
        F.col("run_id").rlike(uuid4).alias("well_formed"),
        (F.col("uses") == 1).alias("unique"),
        (F.col("run_id") == F.col("second")).alias("stable"),
    )


def _enriched(spark, d):
    documents = fx.documents_as_files(spark, d)
    descriptions = logs.description_scan(
        fx.table(spark, d, "benchmark").select(F.col("item_id").alias("config_id"), F.col("text").alias("value"))
    )
    return runs.run_enrich(
        _plain(_results(spark, d)),
        fx.run_timing(spark, d),
        fx.document_labels(spark, d),
        files.artifact_md5(documents),
        descriptions,
    )


def run_summary(spark, d):
    return runs.run_summary(_enriched(spark, d))


# --- filters --------------------------------------------------------------------------

def run_name_valid_(spark, d):
    return fx.run_manifest(spark, d).select(
        "run_id", "run_name", run_name_valid(F.col("run_name")).alias("valid")
    )


def warmup_drop(spark, d):
    return _samples(spark, d)


def _verdicts(spark, d):
    return configs.config_complete(fx.config_manifest(spark, d), fx.CONFIG_RULES)


def config_complete(spark, d):
    return _verdicts(spark, d).withColumn("failed", F.array_join("failed", ","))


def batch_eligible(spark, d):
    return configs.batch_eligible(
        fx.run_manifest(spark, d).withColumn("config_id", F.col("run_id")), _verdicts(spark, d)
    )


def cycle_window(spark, d):
    documents = fx.table(spark, d, "documents")
    key = F.col("doc_id")
    bounds = documents.select(
        key.alias("run_id"),
        F.when(key % 3 == 0, -1).otherwise(key % 10 * 200_000_000).cast("bigint").alias("start"),
        F.when(key % 4 == 0, -1).otherwise(1_500_000_000 + key % 7 * 100_000_000).cast("bigint").alias("end"),
    )
    return series.cycle_window(_samples(spark, d), bounds, BROADCAST_BYTES)


def roi_slice(spark, d):
    events = fx.table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), "event_id", "event_type", "value"
    )
    kind = F.col("event_type")
    return traces.roi_slice(events, kind == "signup", kind == "purchase", "event_id", BROADCAST_BYTES)


# --- joins ----------------------------------------------------------------------------

def metric_merge(spark, d):
    return _merged(spark, d)


def config_overlay(spark, d):
    base = fx.run_manifest(spark, d).withColumn("dry_run", F.lit(True)).withColumn("verbosity", F.lit(2))
    key = F.col("run_id")
    override = base.select(
        "run_id",
        F.when(key % 3 == 0, "cli").alias("runtime"),
        F.when(key % 5 == 0, "").alias("cmd"),
        F.when(key % 4 == 0, False).alias("dry_run"),
        F.when(key % 6 == 0, 0).alias("verbosity"),
        F.when(key % 7 == 0, "fast").alias("partition_flag"),
        F.when(key % 2 == 0, "node").alias("nodelist_flag"),
    )
    return configs.config_overlay(base, override).withColumn("ignored", F.array_join("ignored", ","))


def run_enrich(spark, d):
    return _enriched(spark, d)


def sweep_grid(spark, d):
    programs = fx.run_manifest(spark, d).select(
        F.col("benchmark").alias("program"), "run_config", "fpga"
    ).distinct()
    return runs.sweep_grid(programs, {"runtime": fx.RUNTIMES})


def _covered(spark, d):
    catalogue = fx.run_manifest(spark, d).where(run_name_valid(F.col("run_name"))).withColumnRenamed("benchmark", "program")
    return runs.coverage(sweep_grid(spark, d), catalogue, AXES)


def sweep_coverage(spark, d):
    return _covered(spark, d)


def sweep_gaps(spark, d):
    return runs.coverage_gaps(_covered(spark, d), AXES)


# --- aggregations ---------------------------------------------------------------------

def counter_final(spark, d):
    return metrics.counter_final(_samples(spark, d))


def uart_last_wins(spark, d):
    tokens = logs.uart_scan(fx.log_lines(spark, d), order=("line_no",))
    return metrics.uart_last_wins(tokens)


def results_pivot(spark, d):
    return _plain(_results(spark, d))


def results_every(spark, d):
    """Wide rows with all metrics, no name listed: written, read by path and as the long form."""
    table = written(metrics.results_pivot(_merged(spark, d), every=True))
    found = metrics.every_metric(table).groupBy("run_id").agg(
        F.count("*").alias("n_metrics"), F.array_join(F.sort_array(F.collect_list("name")), "|").alias("names"), F.sum("value").alias("total")
    )
    by_path = table.select("run_id", metrics.metric_at("instructions").alias("instructions"), metrics.metric_at(CYCLES).alias("cycles"))
    return found.join(by_path, "run_id")


def trace_histogram(spark, d):
    words = fx.table(spark, d, "documents").select(
        F.col("doc_id").alias("run_id"), F.explode_outer(F.split("text", " ")).alias("key")
    )
    return traces.trace_histogram(words.where(F.col("key").isNotNull()))


# --- windows, top-k, plots ------------------------------------------------------------

def counter_delta(spark, d):
    return series.counter_delta(_steps(spark, d)).drop("cycles")


def stored_delta(spark, d):
    """Deltas of samples that were stored by series: nothing but the write shuffles them."""
    stored = write_clustered(fx.counter_samples(spark, d), fresh_path(spark, "clustered"))
    return series.counter_delta(series.warmup_drop(with_previous_stored(stored))).drop("cycles")


def stored_final(spark, d):
    stored = write_clustered(_samples(spark, d), fresh_path(spark, "clustered"))
    return metrics.counter_final(stored)


def latest_pointer(spark, d):
    return runs.latest_pointer(fx.run_manifest(spark, d), ("fpga", "benchmark", "runtime"))


def latest_merge(spark, d):
    """Pointers kept by two jobs, each over half of the runs; neither knows the other's."""
    by, manifest = ("fpga", "benchmark", "runtime"), fx.run_manifest(spark, d)
    root = fresh_path(spark, "latest")
    for half in (1, 0):
        merge_rows(manifest.where(F.col("run_id") % 2 == half), root, by, lambda rows: runs.latest_pointer(rows, by))
    return read_current(spark, root, by, manifest)


def latest_pointer_global(spark, d):
    return runs.latest_pointer(fx.run_manifest(spark, d))


def config_menu(spark, d):
    configs_ = fx.run_manifest(spark, d).select(
        F.concat("run_name", F.lit(".bit")).alias("name"), F.col("written_at").alias("mtime")
    )
    return runs.config_menu(configs_)


def plot_series(spark, d):
    deltas = series.delta_table(
        _steps(spark, d), _instructions(spark, d), broadcast_bytes=BROADCAST_BYTES
    )
    return series.plot_series(deltas)


def mpki_report(spark, d):
    return postrun.mpki_report(_tokens(spark, d), fx.counter_samples(spark, d))


# --- through files --------------------------------------------------------------------

def _as_files(texts: DataFrame) -> str:
    """One text file per run below the shared folder; the glob of the files."""
    root = fresh_path(texts.sparkSession, "files")
    write_run_files(texts, root)
    return f"{root}/*/*.txt"


def _by_number(rows: DataFrame) -> DataFrame:
    """The run's number from its directory's name, ``run_id=<number>``."""
    return rows.withColumn("run_id", F.substring_index("run_id", "=", -1).cast("bigint"))


def counter_files(spark, d):
    """Counter files as files: small ones parsed whole, the others by line."""
    return _by_number(counters.read_counter_samples(spark, _as_files(fx.counter_files(spark, d)), whole_file_bytes=2000))


def counter_records(spark, d):
    """The same with quoted newlines in the files, whole and by line."""
    return _by_number(counters.read_counter_samples(spark, _as_files(fx.counter_files(spark, d, notes=True)), whole_file_bytes=4000))


def counter_file_deltas(spark, d):
    """Deltas of counter files as their parsers tell them, whole and by line."""
    samples = counters.read_counter_samples(spark, _as_files(fx.counter_files(spark, d, notes=True)), whole_file_bytes=4000, with_steps=True)
    return _by_number(series.counter_delta(series.warmup_drop(samples)).drop("cycles"))


def artifact_files(spark, d):
    """Artifacts as files, hashed and catalogued; one run has an empty file and nothing else."""
    texts = fx.documents_as_files(spark, d).select(F.col("artifact_id").alias("run_id"), F.col("content").alias("value"))
    root = _as_files(texts).removesuffix("/*/*.txt")
    spark.range(0).select(F.lit("").alias("value")).write.text(f"{root}/run_id=-1")
    hashes = files.read_artifact_hashes(spark, f"{root}/run_id=*/*.txt")
    listed = files.read_run_files(spark, root).select(F.col("path").alias("artifact_id"), "length")
    run = F.regexp_extract("artifact_id", "run_id=(-?[0-9]+)/", 1).cast("bigint")
    return hashes.join(listed, "artifact_id").select(run.alias("run_id"), "length", "md5")


def counter_rejects(spark, d):
    """Cells of counter files without a value, from the one parse that also gives the samples."""
    parsed = counters.read_counter_samples(spark, _as_files(fx.counter_files(spark, d, notes=True)), whole_file_bytes=4000, reasons=True)
    return _by_number(counters.split_rejects(parsed)[1])


def log_files(spark, d):
    return _by_number(metrics.uart_last_wins(logs.read_log_tokens(spark, _as_files(fx.log_files(spark, d)))))


QUERIES: dict[str, Query] = {
    "counter_files": counter_files,
    "counter_records": counter_records,
    "counter_file_deltas": counter_file_deltas,
    "artifact_files": artifact_files,
    "counter_rejects": counter_rejects,
    "log_files": log_files,
    "uart_scan": uart_scan,
    "counter_scan": counter_scan,
    "description_scan": description_scan,
    "artifact_md5": artifact_md5,
    "run_catalog": run_catalog,
    "submission_parse": submission_parse,
    "results_sink": results_sink,
    "raw_series_sink": raw_series_sink,
    "delta_series_sink": delta_series_sink,
    "hue_split": hue_split,
    "hue_compose": hue_compose,
    "metric_name": metric_name,
    "cycles_to_seconds": cycles_to_seconds_,
    "mpki_final": mpki_final,
    "mpki_series": mpki_series,
    "host_walltime": host_walltime_,
    "run_stamp": run_stamp,
    "command_text": command_text,
    "job_kind": job_kind,
    "result_path": result_path,
    "run_id_assign": run_id_assign,
    "run_summary": run_summary,
    "run_name_valid": run_name_valid_,
    "warmup_drop": warmup_drop,
    "config_complete": config_complete,
    "batch_eligible": batch_eligible,
    "cycle_window": cycle_window,
    "roi_slice": roi_slice,
    "metric_merge": metric_merge,
    "config_overlay": config_overlay,
    "run_enrich": run_enrich,
    "sweep_grid": sweep_grid,
    "sweep_coverage": sweep_coverage,
    "sweep_gaps": sweep_gaps,
    "counter_final": counter_final,
    "uart_last_wins": uart_last_wins,
    "results_pivot": results_pivot,
    "results_every": results_every,
    "trace_histogram": trace_histogram,
    "counter_delta": counter_delta,
    "latest_pointer": latest_pointer,
    "latest_merge": latest_merge,
    "stored_delta": stored_delta,
    "stored_final": stored_final,
    "latest_pointer_global": latest_pointer_global,
    "config_menu": config_menu,
    "plot_series": plot_series,
    "mpki_report": mpki_report,
}
