"""Logs that are read while their runs are going.

Spark's file stream takes a file once, so what is appended later would be lost. Here each call lists the logs, and the
listing is the stream: a row says how long a file is now. State per file, kept by Spark in the checkpoint, is
how far it has been read and the last value of each metric so far; only the bytes behind that are read.

After each call the metrics equal those of reading all logs whole. A token at the end of a file may still grow, so it
counts, but is read again next time. A file that has become shorter is another one and is read anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import regex
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runscope.formats import LOG_FILE, LOG_TOKEN_PATTERN
from runscope.sources.listing import list_files, store_of
from runscope.sources.logs import is_run, run_of

#: Bytes that are read at a time.
READ_BYTES = 4 << 20
METRICS = "path string, name string, value double"
_TOKEN = regex.compile(LOG_TOKEN_PATTERN)
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def metrics_in(data: bytes) -> dict[str, float]:
    """Last value of each metric in a piece of a log, named as :func:`runscope.functions.labels.metric_name` does."""
    found = {}
    for token in _TOKEN.findall(data.decode("utf-8", "replace")):
        name, _, digits = token.partition("=")
        found[name.split("_")[1].lower()] = float(digits)
    return found


def appended(url: str, offset: int, length: int) -> Iterator[tuple[int, dict[str, float], bool]]:
    """Pieces of a file from ``offset`` on: where each ends, its metrics, and whether it can't change any more.

    Pieces end behind white space, which no token holds. What follows the last of it comes last.
    """
    system, place = store_of(url)
    rest = b""
    with system.open_input_file(place) as file:
        file.seek(offset)
        while offset + len(rest) < length:
            part = file.read(min(READ_BYTES, length - offset - len(rest)))
            if not part:
                break
            rest += part
            cut = max(rest.rfind(c) for c in (b"\n", b"\r", b" ", b"\t")) + 1
            if cut:
                offset += cut
                yield offset, metrics_in(rest[:cut]), True
                rest = rest[cut:]
    if rest:
        yield offset, metrics_in(rest), False


class LastValues(StatefulProcessor):
    """Per file how far it has been read, and the last value of each metric so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.offset = handle.getValueState("offset", "offset long")
        self.values = handle.getMapState("values", "name string", "value double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timer_values: Any) -> Iterator[Row]:
        """All metrics of a file that has changed; none of one that is as it was."""
        url, length = key[0], max(r.length for r in rows)
        begin = self.offset.get()[0] if self.offset.exists() else 0
        if length == begin and self.offset.exists():
            return
        if length < begin:
            self.values.clear()
            begin = 0
        last, end = {}, begin
        for end, found, final in appended(url, begin, length):
            last.update(found)
            if final:
                for name, value in found.items():
                    self.values.updateValue((name,), (value,))
        self.offset.update((end,))
        known = {k[0]: v[0] for k, v in self.values.iterator()}
        for name, value in {**known, **last}.items():
            yield Row(path=url, name=name, value=value)

    def close(self) -> None:
        pass


def follow_logs(spark: SparkSession, run_dirs: str, target: str, checkpoint: str) -> None:
    """Read what was appended to the logs below ``run_dirs`` since the last call into ``target``.

    A file that changed gets all of its metrics into a new batch of ``target``; see :func:`read_followed`.
    """
    listings = f"{checkpoint}/listings"
    listed = list_files(spark, f"{run_dirs.rstrip('/')}/{LOG_FILE}").where(is_run("path"))
    listed.select("path", "length").withColumn("call", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(listings)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        lengths = spark.readStream.schema("path string, length bigint, call string").parquet(listings)
        metrics = lengths.groupBy("path").transformWithState(LastValues(), METRICS, "Update", "None")

        def write(batch: DataFrame, batch_id: int) -> None:
            rows = batch.select(run_of("path"), "name", "value")
            rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

        query = (
            metrics.writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)


def read_followed(spark: SparkSession, target: str) -> DataFrame:
    """``(run_id, name, value)``: of each run what its newest batch says, which is all there is of it."""
    batches = spark.read.schema("run_id string, name string, value double, batch long").parquet(target)
    newest = batches.groupBy("run_id").agg(F.max("batch").alias("batch"))
    return batches.join(newest, ["run_id", "batch"], "left_semi").select("run_id", "name", "value")
