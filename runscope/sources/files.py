"""Run directories and artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runscope.functions.labels import parse_stamp
from runscope.sources.listing import found_files, hash_files, list_files

# directory "<run name><stamp>", the stamp with or without a dash before the time of day
_STAMP = r"(\d{4}-\d\d-\d\d-?\d{6})(?:/|\z)"


#: What Spark can hold as one value, with some room.
VALUE_BYTES = 2_000_000_000


def read_artifacts(spark: SparkSession, paths: str | Sequence[str], value_bytes: int = VALUE_BYTES) -> DataFrame:
    """Artifact files as ``(artifact_id, content)``; the id is the path. Empty files have an empty content.

    A file that is too large for one value has a NULL content. The sizes prune the listing, so
    its content is not read; :func:`read_artifact_hashes` hashes files of any size.
    """
    files = spark.read.format("binaryFile").load(paths)
    fits = files.where(F.col("length") <= value_bytes).select(F.col("path").alias("artifact_id"), "content")
    larger = files.where(F.col("length") > value_bytes)
    found = fits.unionByName(larger.select(F.col("path").alias("artifact_id"), F.lit(None).cast("binary").alias("content")))
    empty = found_files(spark, [paths] if isinstance(paths, str) else [*paths])[0].where("length = 0").select(_plain("path").alias("artifact_id"))
    return found.unionByName(empty.withColumn("content", F.lit("").cast("binary")))


def _plain(path: str) -> Column:
    """A listed URL as Spark's binary source writes paths: not encoded, and one slash after ``file:``."""
    decoded = F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"\Afile:///", "file:/")


def read_artifact_hashes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Content hash of artifact files, ``(artifact_id, md5)``, of any size: executors read them in pieces."""
    hashed = hash_files(found_files(spark, [paths] if isinstance(paths, str) else [*paths])[0])
    return hashed.select(_plain("artifact_id").alias("artifact_id"), "md5")


def artifact_md5(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Content hash of ``files(artifact_id, content)``, NULL without content.

    ``known(artifact_id, md5)`` supplies hashes of files that have none here, one row each.
    """
    hashed = files.select("artifact_id", F.md5(F.col("content").cast("binary")).alias("md5"))
    if known is None:
        return hashed
    supplied = known.select("artifact_id", F.col("md5").alias("supplied"))
    return hashed.join(supplied, "artifact_id", "left").select("artifact_id", F.coalesce("md5", "supplied").alias("md5"))


def read_run_files(spark: SparkSession, root: str) -> DataFrame:
    """Listing of all files below ``root``: ``(path, length, modificationTime)``; empty files, too.

    The executors list, directory by directory; no content is read.
    """
    files = list_files(spark, root, recursive=True)
    return files.select(_plain("path").alias("path"), "length", F.col("modificationTime").cast("timestamp_ntz").alias("modificationTime"))


def run_catalog(files: DataFrame) -> DataFrame:
    """``files(path, length, modificationTime)`` → run name and stamp of each file.

    Files outside a stamped directory are no part of a run and are left out.
    """
    found = files.withColumn("stamp_at", F.regexp_instr("path", F.lit(_STAMP))).where("stamp_at > 0")
    # the stamp's length tells whether it has the optional dash
    stamp = F.regexp_extract("path", _STAMP, 1)
    before = F.substring(F.col("path"), F.lit(1), F.col("stamp_at") - 1)
    return found.select(
        "path", F.substring_index(before, "/", -1).alias("run_name"), stamp.alias("stamp"), "length", "modificationTime"
    ).select(
        "path",
        "run_name",
        F.coalesce(
            F.when(F.length("stamp") == 16, parse_stamp(F.col("stamp"), "run")),
            F.when(F.length("stamp") == 17, parse_stamp(F.col("stamp"), "report")),
        ).alias("stamped_at"),
        "length",
        F.col("modificationTime").alias("modified_at"),
    )
