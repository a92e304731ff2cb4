"""Console logs, descriptions and submission logs.

Readers and parsers are separate: a parser takes text from a table or from files alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runscope.formats import (
    LOG_TOKEN_PATTERN,
    LOG_TOKEN_PREFIX,
    NO_JOB_ID,
    SUBMITTED_PATTERN,
    UNKNOWN_DESCRIPTION,
)
from runscope.functions.labels import metric_name
from runscope.functions.text import ascii_digits, strip_whitespace
from runscope.sources.listing import list_files
from runscope.sources.texts import listed_texts, text_lines

# the last directory of a file's path
_DIRECTORY = r"/([^/]+)/[^/]+\z"


#: A link beside the run directories to the newest of them (fixed name); it is no run.
LATEST = "latest"


def run_of(path: str, name: str = "run_id") -> Column:
    """The run (or configuration) a file belongs to: its directory's name.

    Readers give paths as URLs, so ``%20`` and the like are decoded; a plus sign stays.
    """
    encoded = F.replace(F.regexp_extract(path, _DIRECTORY, 1), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded).alias(name)


def is_run(path: str) -> Column:
    """Whether a file is in a run's directory, not below the link to the newest."""
    return F.regexp_extract(path, _DIRECTORY, 1) != LATEST


def text_of(spark: SparkSession, paths: str | Sequence[str], name: str | None = None, wholetext: bool = False) -> DataFrame:
    """Text files below ``paths``; with ``name``, ``paths`` are directories and files of that name count.

    Directories without such a file are no error then.
    """
    reader = spark.read.option("pathGlobFilter", name) if name else spark.read
    return reader.text(paths, wholetext=wholetext)


def _token_array(text: str) -> Column:
    """Tokens of a text; the prefix test spares texts without any from the regex."""
    return F.when(
        F.col(text).contains(LOG_TOKEN_PREFIX),
        F.regexp_extract_all(text, F.lit(LOG_TOKEN_PATTERN), F.lit(0)),
    )


def _name_and_value(name_mode: str) -> list[Column]:
    return [
        metric_name(F.substring_index("token", "=", 1), name_mode).alias("name"),
        ascii_digits(F.substring_index("token", "=", -1)).cast("double").alias("value"),
    ]


def uart_scan(files: DataFrame, order: Sequence[str] = (), name_mode: str = "token") -> DataFrame:
    """All metric tokens of ``files(run_id, value)`` → ``(run_id, pos, name, value)``.

    A token cannot span a newline, so whole texts and single lines give the same tokens. With
    whole texts (one row per run) ``pos`` is the token's number. With one row per line, ``order``
    names the columns that order the lines, and ``pos`` is a struct of them and the number
    within the line. Either way ``pos`` sorts in log order.
    """
    # The outer form: otherwise the optimizer adds a filter that runs the regex a second time.
    found = files.select(
        "run_id", *order, F.posexplode_outer(_token_array("value")).alias("nth", "token")
    ).where(F.col("token").isNotNull())
    pos = F.struct(*order, "nth") if order else F.col("nth").cast("bigint")
    return found.select("run_id", pos.alias("pos"), *_name_and_value(name_mode))


def scan_log_lines(lines: DataFrame, name_mode: str = "token") -> DataFrame:
    """S1 on ``lines(path, block, value)`` that come straight from the text reader.

    The result, ``(run_id, block, pos, name, value)``, sorts in log order by ``(block, pos)``: the
    byte offset of the split a token came from, then an ascending id within that split's task.
    So one huge log is spread over many tasks, and nothing is shuffled to number its tokens.
    """
    return (
        lines.select("path", "block", F.explode_outer(_token_array("value")).alias("token"))
        .where(F.col("token").isNotNull())
        .select(
            run_of("path"), "block", F.monotonically_increasing_id().alias("pos"), *_name_and_value(name_mode)
        )
    )


def line_columns() -> list[Column]:
    """A text reader's lines as ``(path, block, value)``; the block is their split's byte offset."""
    return [
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value"),
    ]


def read_log_tokens(
    spark: SparkSession, paths: str | Sequence[str], name_mode: str = "token", name: str | None = None
) -> DataFrame:
    """All tokens of all logs below ``paths``; the run is the file's directory. On ``name`` see :func:`text_of`."""
    files = listed_texts(spark, paths, name)
    if files is None:
        lines = text_of(spark, paths, name).select(*line_columns()).where(is_run("path"))
    else:
        lines = text_lines(files.where(is_run("path"))).drop("seq")
    return scan_log_lines(lines, name_mode)


def read_descriptions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Description files as ``(config_id, value)``.

    DataFrame readers leave out empty files, which must be told apart from missing ones here; the
    executors' listing has them.
    """
    names = list_files(spark, paths)
    empty = names.where("length = 0").select("path", F.lit("").alias("value"))
    if names.where("length > 0").isEmpty():
        return empty.select(run_of("path", "config_id"), "value")
    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return texts.unionByName(empty).select(run_of("path", "config_id"), "value")


def description_scan(files: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """S3: trimmed description per config, ``'Unk.'`` where there is none.

    A NULL value stands for an unreadable file; ``configs(config_id)`` adds the configs that
    have no file at all. An empty file stays empty.
    """
    if configs is not None:
        files = configs.select("config_id").join(files, "config_id", "left")
    return files.select(
        "config_id",
        F.coalesce(strip_whitespace(F.col("value")), F.lit(UNKNOWN_DESCRIPTION)).alias("description"),
    )


def submission_parse(log: DataFrame) -> DataFrame:
    """Job id in ``log(run_id, stdout)``, -1 where the text is no success message."""
    digits = ascii_digits(F.regexp_extract("stdout", SUBMITTED_PATTERN, 1))
    job_id = F.when(digits != "", digits.try_cast("bigint"))  # a failing cast is slow
    return log.select(
        "run_id", F.coalesce(job_id, F.lit(NO_JOB_ID).cast("bigint")).alias("job_id")
    )
