"""Listings made by the executors: one directory is one row of work, and the driver holds no list.

Spark's file sources list on the driver and leave out empty files. Here a table of directories is listed level by
level: each row's children become the next level's rows, and every level is written to the shared folder. A glob's
patterns are matched level by level too, so only directories that match are listed.

Executors reach files through Arrow's file systems. A store that only Spark's own classes reach is listed
by the driver instead (see :func:`reachable`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from runscope.session import written

FILES = "path string, length bigint, modificationTime timestamp"
_FOUND = "path string, is_dir boolean, length bigint, modificationTime timestamp"
#: Levels of directories at most; a link to a directory above it would make them endless.
MAX_LEVELS = 64
#: Bytes of a file that are read at a time.
READ_BYTES = 4 << 20
#: Files or directories, and bytes, that a task is given at most; and files or directories that are worth a task where cores are idle.
TASK_ROWS, TASK_BYTES, LEAST_ROWS = 2048, 32 << 20, 128


def reachable(url: str) -> bool:
    """Whether executors can list and read this place themselves."""
    return urlsplit(url).scheme in ("file", "hdfs", "s3", "gs", "abfs")


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a URL, with the scheme that the session's configuration gives it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(where).toUri().toString()


def store_of(url: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a URL, and the place in it."""
    parts = urlsplit(url)
    if parts.scheme == "file":
        return fs.LocalFileSystem(), unquote(parts.path)
    system, _ = fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}/")
    return system, f"{parts.netloc}{unquote(parts.path)}" if parts.scheme in ("s3", "gs", "abfs") else unquote(parts.path)


def glob_pattern(part: str) -> str:
    """The regular expression of one part of a glob: ``* ? [ab] [!ab] {a,b}`` and ``\\`` before a character."""
    out, depth, i = "", 0, 0
    while i < len(part):
        c, rest = part[i], part[i + 1 :]
        if c == "\\" and rest:
            out, i = out + re.escape(rest[0]), i + 1
        elif c == "[" and "]" in rest[1:]:
            end = rest.index("]", 1)
            inside = rest[:end].replace("\\", "\\\\")
            out += f"[^{inside[1:]}]" if inside[0] in "!^" else f"[{inside}]"
            i += end + 1
        elif c in "{}" or (c == "," and depth):
            depth += {"{": 1, "}": -1}.get(c, 0)
            out += {"{": "(?:", "}": ")", ",": "|"}[c]
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return out


def _has_pattern(part: str) -> bool:
    return bool(re.search(r"[*?\[{\\]", part))


def _level(pattern: str | None) -> callable:
    """Children of a task's directories whose names match."""
    matches = re.compile(pattern or ".*", re.S).fullmatch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                system, place = store_of(url)
                found = []
                for info in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                    if matches(info.base_name) and info.type in (fs.FileType.File, fs.FileType.Directory):
                        is_dir = info.type == fs.FileType.Directory
                        found.append((f"{url.rstrip('/')}/{quote(info.base_name)}", is_dir, 0 if is_dir else info.size, info.mtime))
                for begin in range(0, len(found), 10_000):
                    columns = list(zip(*found[begin : begin + 10_000], strict=True))
                    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "is_dir", "length", "modificationTime"])

    return run


def dealt(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` of work dealt out by ``key``, in as many tasks as their number and ``length``, in bytes, ask for.

    Left alone, Spark puts rows as short as paths into a few tasks, however much work they stand for.
    """
    length = F.sum("length") if "length" in rows.columns else F.lit(0)
    n, size = rows.agg(F.count("*"), F.coalesce(length, F.lit(0))).first()
    idle = min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS))
    tasks = max(1, -(-n // TASK_ROWS), -(-size // TASK_BYTES), idle)
    return rows.repartition(tasks, F.xxhash64(*key))


def _below(spark: SparkSession, dirs: DataFrame, pattern: str | None) -> DataFrame:
    """One level, written: a directory is a row, and rows are dealt out anew, as some have many children."""
    return written(dealt(dirs.select("path"), ["path"]).mapInArrow(_level(pattern), _FOUND), "listing")


def _listed_by_driver(spark: SparkSession, glob: str, recursive: bool) -> DataFrame:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(glob)
    system, rows, found = where.getFileSystem(conf), [], []
    for status in system.globStatus(where) or []:
        if status.isFile():
            found.append(status)
        elif recursive:
            below = system.listFiles(status.getPath(), True)
            while below.hasNext():
                found.append(below.next())
    for s in found:
        rows.append((s.getPath().toUri().toString(), s.getLen(), s.getModificationTime() / 1000))
    listed = spark.createDataFrame(rows, "path string, length bigint, at double")
    return listed.select("path", "length", F.timestamp_millis((F.col("at") * 1000).cast("bigint")).alias("modificationTime"))


def list_files(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """Files that match the globs, empty ones included: ``(path, length, modificationTime)``, paths as URLs.

    With ``recursive`` also all files below the directories that match. What matches several globs is there once.
    """
    made = [part for glob in ([paths] if isinstance(paths, str) else paths) for part in _listed(spark, glob, MAX_LEVELS if recursive else 0)[0]]
    return _united(spark, made, several=not isinstance(paths, str))


def found_files(spark: SparkSession, globs: Sequence[str]) -> tuple[DataFrame, bool]:
    """Files that match the globs or lie in directories that do, as Spark's file sources take them, each once.

    Also whether those directories hold partitions, ``<name>=<value>``, into which such sources go down.
    """
    parts = [_listed(spark, glob, 1) for glob in globs]
    dirs = [d for _, below in parts for d in below]
    partitioned = any(not d.where(r"path rlike '(=|%3D)[^/]*\\z'").isEmpty() for d in dirs)
    return _united(spark, [m for made, _ in parts for m in made], several=len(globs) > 1), partitioned


def reachable_all(spark: SparkSession, globs: Sequence[str]) -> bool:
    """Whether executors can list and read all that may match."""
    return all(reachable(_start(spark, glob)[0]) for glob in globs)


def _start(spark: SparkSession, glob: str) -> tuple[str, list[str]]:
    """The directory that a glob begins in, as a URL, and its parts from there on."""
    parts = glob.split("/")
    fixed = next((i for i, part in enumerate(parts) if _has_pattern(part)), len(parts) - 1)
    return qualified(spark, "/".join(parts[:fixed]) or "/"), [p for p in parts[fixed:] if p]


def _listed(spark: SparkSession, glob: str, levels: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Files that match a glob, and of so many levels of directories below; then the directories of the last level, if there was one."""
    start, patterns = _start(spark, glob)
    if not reachable(start):
        below = [f"{glob.rstrip('/')}/*"] if levels == 1 else []
        return [_listed_by_driver(spark, g, levels > 1) for g in (glob, *below)], []
    made, dirs = [], spark.createDataFrame([(start,)], "path string")
    for i, part in enumerate(patterns):
        found = _below(spark, dirs, glob_pattern(part))
        dirs = found.where("is_dir")
        if i == len(patterns) - 1:
            made.append(found.where("not is_dir"))
    level = 0
    while level < levels and not dirs.isEmpty():
        found = _below(spark, dirs, None)
        made.append(found.where("not is_dir"))
        dirs, level = found.where("is_dir"), level + 1
    if levels == MAX_LEVELS and level == levels and not dirs.isEmpty():
        raise ValueError(f"more than {MAX_LEVELS} levels of directories below {glob}")
    return made, [dirs] if level else []


def _united(spark: SparkSession, made: Sequence[DataFrame], several: bool) -> DataFrame:
    rows = [m.select("path", "length", "modificationTime") for m in made]
    every = reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], FILES)
    return every.dropDuplicates(["path"]) if several and len(made) > 1 else every


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = []
        for url in batch.column(0).to_pylist():
            system, place = store_of(url)
            md5 = hashlib.md5(usedforsecurity=False)
            with system.open_input_stream(place) as stream:
                while part := stream.read(READ_BYTES):
                    md5.update(part)
            hashes.append(md5.hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(hashes, pa.string())], ["artifact_id", "md5"])


def hash_files(files: DataFrame) -> DataFrame:
    """``files(path)``, if known with ``length``, → ``(artifact_id, md5)``: each file is read in pieces, so it may have any size, also none."""
    spread = dealt(files.select("path", *[c for c in files.columns if c == "length"]), ["path"])
    return spread.select(F.col("path").alias("artifact_id")).mapInArrow(_hashed, "artifact_id string, md5 string")
