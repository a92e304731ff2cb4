"""Session helpers: a test/bench session, and the shared folder jobs may write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: int | str = "*", app: str = "runscope", **conf: str) -> SparkSession:
    """Session for tests and bench.py. Cluster jobs bring their own session."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _folder_of_local_session(application: str) -> str:
    return tempfile.mkdtemp(prefix="runscope-")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local[...] session may fall back to a temporary folder of this machine; on a
    cluster the executors could not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _folder_of_local_session(spark.sparkContext.applicationId)


_jobs: list[list[str]] = []


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder; it goes with the :func:`job` it was made in."""
    path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    if _jobs:
        _jobs[-1].append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store Spark reaches by its path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """What is written to fresh paths within is deleted at the end, also after an error.

    For work that ends with its own output. A query that returns a DataFrame can't use it, as
    its rows are read later; its intermediates stay until the cluster clears the folder.
    """
    _jobs.append([])
    try:
        yield
    finally:
        for path in _jobs.pop():
            delete_path(spark, path)


def written(df: DataFrame, purpose: str = "table") -> DataFrame:
    """``df`` as Parquet in the shared folder: computed once, its lineage cut."""
    path = fresh_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the Parquet files of a folder; only their listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.sum("length")).first()[0] or 0
