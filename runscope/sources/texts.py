"""Text files of any number and size, listed and read by the executors.

Spark's text reader lists on the driver, a directory after the other, which takes longer than all else where each of
many runs has its own. Here the executors list (see :mod:`runscope.sources.listing`), and a task reads its share
of the files, whole or by line. What only Spark's reader knows how to read is left to it: :func:`listed_texts` tells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from runscope.session import written
from runscope.sources.listing import dealt, found_files, glob_pattern, reachable_all, store_of

#: Bytes of a large file that one task reads at a time; a line belongs to the block that it begins in.
BLOCK_BYTES = 32 << 20
#: Bytes that are read at a time to find the end of a block's last line, and bytes and rows of a batch.
TAIL_BYTES, BATCH_BYTES, BATCH_ROWS = 64 << 10, 4 << 20, 10_000
#: Names that Spark's reader decompresses.
_PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd|xz|Z)\z"
#: Names that Spark's readers pass over.
_HIDDEN = r"\A([.]|_(?!metadata\z|common_metadata\z)[^=]*\z)|\._COPYING_\z"


def listed_texts(spark: SparkSession, paths: str | Sequence[str], name: str | None = None) -> DataFrame | None:
    """Text files that match, or lie in directories that do, as ``(path, length)``; the empty ones are left out.

    With ``name`` only files whose name matches it. ``None`` where Spark's reader has to be asked: in a store that Arrow
    doesn't reach, of compressed files, of directories that hold partitions, and if there is nothing at all.
    """
    globs = [paths] if isinstance(paths, str) else [*paths]
    if not reachable_all(spark, globs):
        return None
    files, partitioned = found_files(spark, globs)
    if partitioned:
        return None
    base = F.url_decode(F.replace(F.regexp_extract("path", r"/([^/]+)\z", 1), F.lit("+"), F.lit("%2B")))
    files = files.where((F.col("length") > 0) & ~base.rlike(_HIDDEN))
    if name:
        files = files.where(base.rlike(rf"(?s)\A(?:{glob_pattern(name)})\z"))
    # written, as it is read many times: for counts, and for small and large files
    files = written(files.select("path", "length", base.rlike(_PACKED).alias("packed")), "texts")
    packed = files.agg(F.count("*"), F.count_if("packed")).first()
    return files.select("path", "length") if packed[0] and not packed[1] else None


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, texts, size = [], [], 0
    for batch in batches:
        for url in batch.column(0).to_pylist():
            system, place = store_of(url)
            with system.open_input_stream(place) as stream:
                texts.append(stream.read())
            paths.append(url)
            size += len(texts[-1])
            if size >= BATCH_BYTES or len(paths) >= BATCH_ROWS:
                yield pa.record_batch([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], ["path", "value"])
                paths, texts, size = [], [], 0
    if paths:
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], ["path", "value"])


def whole_texts(files: DataFrame) -> DataFrame:
    """``files(path, length)`` → ``(path, value)``: the text of each, in one row."""
    read = dealt(files.select("path", "length"), ["path"]).mapInArrow(_whole, "path string, value binary")
    return read.select("path", F.col("value").cast("string").alias("value"))


def block_lines(read_at, begin: int, end: int, size: int) -> list[bytes]:
    """The lines of a file that begin within a block of it; ``\\n``, ``\\r`` and both in that order end a line.

    ``read_at(bytes, place)`` reads from the file. The last line may go on behind the block.
    """
    lead = min(begin, 1)
    data = read_at(end - begin + lead, begin - lead)
    start = 0
    if lead:
        ended = re.search(rb"\r\n?|\n", data)
        if not ended or ended.end() >= len(data):
            return []
        start = ended.end()
    parts, at = [data[start:]], end
    while at < size and parts[-1][-1:] not in (b"\n", b"\r"):
        more = read_at(min(TAIL_BYTES, size - at), at)
        at += len(more)
        ended = re.search(rb"\r|\n", more)
        parts.append(more[: ended.end()] if ended else more)
    text = b"".join(parts)
    return (text if begin else text.removeprefix(b"\xef\xbb\xbf")).splitlines()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, int, int, bytes]] = []
    size = 0

    def out() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        columns = zip(*held, strict=True)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "block", "seq", "value"])

    for batch in batches:
        for url, begin, end, length in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end", "length")), strict=True):
            system, place = store_of(url)
            with system.open_input_file(place) as file:
                lines = block_lines(file.read_at, begin, end, length)
            for seq, line in enumerate(lines):
                held.append((url, begin, seq, line))
                size += len(line)
                if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def text_lines(files: DataFrame) -> DataFrame:
    """``files(path, length)`` → ``(path, block, seq, value)``, a row per line: its block's first byte, its number there.

    A block's rows stay together and in order.
    """
    spark = files.sparkSession
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()  # a size with a unit, as Spark reads it
    block = min(BLOCK_BYTES, int(most))
    begin = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block).cast("bigint")))
    blocks = files.where("length > 0").select("path", F.col("length").alias("size"), begin.alias("begin"))
    blocks = blocks.select("path", "begin", F.least(F.col("begin") + block, "size").alias("end"), F.col("size").alias("whole"))
    shared = dealt(blocks.withColumn("length", F.col("end") - F.col("begin")), ["path", "begin"])
    read = shared.select("path", "begin", "end", F.col("whole").alias("length")).mapInArrow(_lines, "path string, block bigint, seq bigint, value binary")
    return read.withColumn("value", F.col("value").cast("string"))
