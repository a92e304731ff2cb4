"""Run telemetry derived from the given tables.

The tables hold no logs or counter files, so queries derive them, row by row: one run per
document, one sample and one log line per sentence of its whole text. No derivation gathers
or orders a run, so all of them scale with the tables, whatever a run's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runscope.formats import CYCLES, Rule

COUNTERS = ("l1_htlb_miss", "l2_htlb_miss", "l1_tlb_miss", "l2_tlb_miss", "click")
LOG_METRICS = ("instructions", "error", "click", "view", "l1")
RUNTIMES = ("libc", "stub", "localize", "handles")
CONFIG_RULES = (
    Rule("driver", kind="file", readable=True, executable=True),
    Rule("bitstream", readable=True),
    Rule("image", kind="file", readable=True, suffix=".img"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, sample_idx, n)``: the length of each sentence of each document."""
    return (
        table(spark, sf_dir, "documents")
        .select(
            F.col("doc_id").alias("run_id"),
            F.posexplode_outer(F.split("text", r"\.")).alias("nth", "sentence"),
        )
        .where(F.col("sentence").isNotNull())
        .select("run_id", F.col("nth").cast("bigint").alias("sample_idx"), F.length("sentence").cast("bigint").alias("n"))
    )


def _counter_values(idx: Column, n: Column) -> dict[str, Column]:
    """Growing counter values of sample ``idx`` whose sentence has ``n`` characters."""
    k = idx + 1
    return {
        CYCLES: k * 100_000_000,
        "l1_htlb_miss": k * 64 + n % 64,
        "l2_htlb_miss": k * 32 + n % 32,
        "l1_tlb_miss": k * 128 + n * 7 % 128,
        "l2_tlb_miss": k * 16 + n % 16,
        "click": k * 8 + n % 8,
    }


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw samples ``(run_id, sample_idx, cycles, counter, value)``, warm-up included."""
    values = _counter_values(F.col("sample_idx"), F.col("n"))
    pairs = [x for name, value in values.items() for x in (F.lit(name), value)]
    return _sentences(spark, sf_dir).select(
        "run_id",
        "sample_idx",
        values[CYCLES].alias("cycles"),
        F.stack(F.lit(len(values)), *pairs).alias("counter", "value"),
    )


def counter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same samples as a file's parser has them: per run its ``counters`` and an array of their values per sample."""

    def line(sentence: Column, i: Column) -> Column:
        return F.array(*_counter_values(i.cast("bigint"), F.length(sentence).cast("bigint")).values())

    names = F.array(*[F.lit(name) for name in _counter_values(F.lit(0), F.lit(0))])
    runs = table(spark, sf_dir, "documents").where("text is not null")
    return runs.select(F.col("doc_id").alias("run_id"), names.alias("counters"), F.transform(F.split("text", r"\."), line).alias("lines"))


def counter_files(spark: SparkSession, sf_dir: str, notes: bool = False) -> DataFrame:
    """The same samples as the text of one CSV file per run: ``(run_id, value)``.

    With ``notes``, descriptions of some samples are quoted, hold commas, quotes and newlines, and some samples
    have nothing but a newline in theirs. With the irregularities real files have: a comma within a quoted header name, padded
    cells, fractions, cells that are no number, blank lines and two kinds of line ends.
    """

    def note(n: Column) -> Column:
        plain = F.lit("x")
        return F.when(n % 3 == 0, '"a, ""b""\n1,2\n"').when(n % 7 == 0, '"\n\n"').when(n % 11 == 0, 'x"y').otherwise(plain) if notes else plain

    def sample_lines(sentence: Column, i: Column) -> Column:
        n = F.length(sentence).cast("bigint")
        cells = _counter_values(i.cast("bigint"), n)
        padded = F.concat(F.lit(" "), cells["l1_htlb_miss"].cast("string"), F.lit(" "))
        fraction = F.concat(cells["l2_htlb_miss"].cast("string"), F.lit(".75"))
        bad = F.when(n % 97 == 0, "n/a").otherwise(cells["l2_tlb_miss"].cast("string"))
        line = F.concat_ws(
            ",", note(n), cells[CYCLES].cast("string"), padded, fraction,
            cells["l1_tlb_miss"].cast("string"), bad, cells["click"].cast("string"),
        )
        return F.concat(line, F.when(n % 5 == 0, "\n\n").when(n % 5 == 1, "\r\n").otherwise("\n"))

    head = f'a\nb\nc\ndescription,{CYCLES},l1_htlb_miss,l2_htlb_miss,l1_tlb_miss,l2_tlb_miss,"click, all"\nt\nw\naw\n'
    body = F.array_join(F.transform(F.split("text", r"\."), sample_lines), "")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("run_id"), F.concat(F.lit(head), body).alias("value")
    )


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Console log text of each run: ``(run_id, value)``; some lines hold two tokens."""

    def log_line(sentence: Column) -> Column:
        n = F.length(sentence)
        name = (
            F.when(n % 5 == 0, "INSTRUCTIONS")
            .when(n % 5 == 1, "ERROR_X")
            .when(n % 5 == 2, "CLICK_X")
            .when(n % 5 == 3, "VIEW_X")
            .otherwise("L1_HTLB_MISS")
        )
        value = F.when(n % 5 == 0, n % 20 * 1000).otherwise(n * 13 % 1000)
        second = F.when(n % 7 == 0, F.concat(F.lit(" YUKON_VIEW_Y="), n.cast("string"), F.lit("!"))).otherwise("")
        return F.concat(F.lit("boot YUKON_"), name, F.lit("="), value.cast("string"), F.lit(" tail"), second)

    text = F.array_join(F.transform(F.split("text", r"\."), log_line), "\n")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), text.alias("value"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log as one row per line, ordered by line_no: ``(run_id, line_no, value)`` from events."""
    name = F.when(F.col("event_type") == "signup", "INSTRUCTIONS").otherwise(
        F.concat(F.upper("event_type"), F.lit("_X"))
    )
    digits = F.regexp_extract("props", "([0-9]+)", 1)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("line_no"),
        F.concat(F.lit("boot YUKON_"), name, F.lit("="), digits, F.lit(" tail")).alias("value"),
    )


def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records, some with an invalid or empty name, some without a command."""
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        key.alias("run_id"),
        F.concat(F.lit("bench"), F.col("o_custkey") % 5).alias("benchmark"),
        F.when(key % 4 == 0, "libc").when(key % 4 == 1, "stub").when(key % 4 == 2, "localize")
        .otherwise("handles").alias("runtime"),
        F.concat(F.lit("r"), key % 3).alias("run_config"),
        F.concat(F.lit("cfg"), F.col("o_custkey") % 7).alias("fpga"),
        F.when(key % 11 == 0, F.concat(F.lit("bad name/"), key)).when(key % 13 == 0, "")
        .otherwise(F.concat(F.lit("run-"), key, F.lit("_"), F.substring(priority, 1, 1))).alias("run_name"),
        F.when(key % 9 == 0, None).when(key % 9 == 1, "")
        .otherwise(F.concat(F.lit("echo "), priority)).alias("cmd"),
        F.col("o_orderdate").alias("written_at"),
    )


def run_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of each run: ``(run_id, started_at, ended_at)``."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("run_id"))
        .agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    )


def submission_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output of submit commands: failures, and a leading blank that must not match."""
    key = F.col("o_orderkey")
    done = F.concat(F.lit("Submitted batch job "), F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        key.alias("run_id"),
        F.when(key % 7 == 0, "sbatch: error: invalid partition")
        .when(key % 7 == 1, F.concat(F.lit(" "), done))
        .when(key % 7 == 2, F.concat(done, F.lit("\n")))
        .otherwise(done)
        .alias("stdout"),
    )


def config_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of configurations with kind and access."""
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("config_id"),
        F.when(line <= 2, "driver").when(line <= 4, "bitstream").when(line <= 6, "image")
        .otherwise("lib.so.1").alias("member"),
        F.when(F.col("l_quantity") > 5, "file").otherwise("dir").alias("kind"),
        F.concat(F.lit("root"), F.when(F.col("l_tax") > 0.02, ".img").otherwise(".bin")).alias("file_name"),
        (F.col("l_returnflag") != "R").alias("readable"),
        (F.col("l_linestatus") == "O").alias("executable"),
    )


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an artifact and as a description file that may be unreadable."""
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        key.alias("artifact_id"),
        F.col("text").alias("content"),
        key.alias("config_id"),
        F.when(key % 5 != 0, F.concat(F.lit("  \t"), F.col("text"), F.lit(" \n"))).alias("value"),
    )


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each document's run in the results tree, and what it ran."""
    config = F.concat_ws(".", "lang", F.lit("libc"), F.lit("r0"), "source")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("run_id"),
        F.col("source").alias("series"),
        F.col("lang").alias("name"),
        config.alias("config"),
        F.concat(F.lit("echo "), F.col("doc_id")).alias("command"),
        F.concat(F.lit("/work/"), F.col("source")).alias("dir"),
        (F.col("doc_id") % 250).alias("config_id"),
        F.col("doc_id").alias("artifact_id"),
    )
