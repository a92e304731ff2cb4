"""A text file per run, written by the tasks that hold the rows."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runscope.sources.listing import qualified, reachable, store_of

#: What Spark calls the directory of a NULL.
_NULL = "__HIVE_DEFAULT_PARTITION__"


def write_run_files(texts: DataFrame, root: str) -> None:
    """``texts(run_id, value)`` as ``<root>/run_id=<run>/part-<task>.txt``, a line per row, as Spark's partitioned text writer does.

    That one has the driver move each file into its place, one by one, when the job ends. Here a task moves a file when it is whole.
    Its name is the task's, so a task that runs again replaces what an earlier attempt left. Stores that Arrow doesn't reach get
    Spark's writer.
    """
    texts = texts.select("run_id", "value")
    where = qualified(texts.sparkSession, root)
    if not reachable(where) or dict(texts.dtypes)["run_id"] not in ("int", "bigint"):  # others need Spark's escaping of names
        texts.write.partitionBy("run_id").text(root)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = store_of(where)
        attempt, run, stream, made = uuid.uuid4().hex, (), None, 0

        def place() -> str:
            return posixpath.join(top, f"run_id={_NULL if run[0] is None else run[0]}")

        def closed() -> None:
            stream.close()
            system.move(f"{place()}/.{attempt}", f"{place()}/part-{task:05d}.txt")

        for batch in batches:
            runs, values, tasks = (batch.column(c).to_pylist() for c in range(3))
            for this, value, task in zip(runs, values, tasks, strict=True):
                if run != (this,):
                    if stream is not None:
                        closed()
                    run = (this,)
                    system.create_dir(place(), recursive=True)
                    stream, made = system.open_output_stream(f"{place()}/.{attempt}"), made + 1
                if value is not None:
                    stream.write(value)
                stream.write(b"\n")
        if stream is not None:
            closed()
        yield pa.record_batch([pa.array([made], pa.int64())], ["files"])

    # sorted as that writer sorts, with rows of a run in their order
    rows = texts.withColumn("at", F.monotonically_increasing_id()).sortWithinPartitions("run_id", "at")
    rows = rows.select("run_id", F.col("value").cast("binary"), F.spark_partition_id().alias("task"))
    rows.mapInArrow(write, "files bigint").agg(F.sum("files")).first()
