"""Tables whose places (combinations of the partition columns) are replaced all at once or not at all.

Each write goes to a folder of its own, ``<root>/version=<id>/<partitions>``. The manifest of the table, one
row per place with the version that holds its current rows, is written as a new table beside it, and a marker
file ``_commits/<number>`` that names it comes last: what has no marker doesn't count, so a job that is
lost before leaves the earlier rows whole. A marker's name is taken by one writer only; another one
that had the same number in mind starts again from the manifest that won.

Readers take the rows whose version is the manifest's for their place. Nothing is deleted
place by place: versions that neither the current nor the manifest before it names go as whole folders.
Folders of writers that were lost stay until :func:`drop_unused` is asked to take them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from runscope.joins import BROADCAST_BYTES, join_per_key
from runscope.session import delete_path

VERSION = "version"
#: Live versions that make a commit rewrite the small ones' places into one.
MAX_VERSIONS = 32
#: Markers kept; a reader needs the last only.
KEPT_MARKERS = 8
_MARKER = "{:012d}"


class Conflict(Exception):
    """Another writer took the number."""


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its class."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _markers(spark: SparkSession, root: str) -> list[str]:
    """Names of the markers, oldest first: a few, as older ones go."""
    system, where = _files(spark, f"{root}/_commits")
    if not system.exists(where):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(where) if s.getLen() > 0)


def _named(spark: SparkSession, root: str, marker: str) -> list[str]:
    """What a marker holds: the manifest's name, then the versions that it names."""
    system, where = _files(spark, f"{root}/_commits/{marker}")
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode().split()
    finally:
        stream.close()


def _claim(spark: SparkSession, root: str, number: int, names: Sequence[str]) -> None:
    """Create the marker, or fail if there is one of this number: the commit itself."""
    system, where = _files(spark, f"{root}/_commits/{_MARKER.format(number)}")
    try:
        stream = system.create(where, False)
    except Py4JJavaError as e:
        if system.exists(where):
            raise Conflict(number) from e
        raise
    stream.write(bytearray("\n".join(names).encode()))
    stream.close()


def _as_places(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct places as the manifest writes them: NULL and empty labels share a folder."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by]).distinct()


def _manifest_at(spark: SparkSession, root: str, name: str, by: Sequence[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in (*by, VERSION))
    return spark.read.schema(schema).parquet(f"{root}/_manifests/{name}")


def current(spark: SparkSession, root: str, by: Sequence[str]) -> tuple[int, DataFrame]:
    """The last commit's number, 0 without any, and its manifest: the version of each place."""
    markers = _markers(spark, root)
    if not markers:
        return 0, spark.createDataFrame([], ", ".join(f"`{c}` string" for c in (*by, VERSION)))
    return int(markers[-1]), _manifest_at(spark, root, _named(spark, root, markers[-1])[0], by)


def _write_version(df: DataFrame, root: str, by: Sequence[str], fmt: str) -> str:
    """Rows into a version of their own; few files for small places, several tasks for a hot one."""
    version = uuid.uuid4().hex
    rows = df.hint("rebalance", *[F.col(c) for c in by])
    rows.write.format(fmt).partitionBy(*by).option("header", "true").save(f"{root}/{VERSION}={version}")
    return version


def _listed_places(spark: SparkSession, root: str, versions: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The places that versions have files of, with the version: from the files' paths, no row is read.

    So ``by`` can't have a name that Spark's listing of files has, as ``path`` or ``length``.
    """
    names, folders = [*by, VERSION], [f"{root}/{VERSION}={v}" for v in versions]
    listing = spark.read.format("binaryFile").option("basePath", root)
    found = listing.load(folders)
    if not set(by) <= set(found.columns):  # a version without any row has no places
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in names))
    schema = StructType([f for f in found.schema.fields if f.name not in names] + [StructField(c, StringType()) for c in names])
    return _as_places(listing.schema(schema).load(folders), names)


def replace_places(
    df: DataFrame, root: str, by: Sequence[str], places: DataFrame | None = None, fmt: str = "parquet"
) -> None:
    """Replace the places that ``df`` has rows of, and empty those of ``places`` that it has none of."""
    spark = df.sparkSession
    version = _write_version(df, root, by, fmt)
    written = _listed_places(spark, root, [version], by).select(*by)
    touched = written if places is None else written.unionByName(_as_places(places, by)).distinct()
    while True:
        number, manifest = current(spark, root, by)
        kept = manifest.join(touched, list(by), "left_anti")
        try:
            if _commit(spark, root, by, number, kept.unionByName(written.withColumn(VERSION, F.lit(version)))) > MAX_VERSIONS:
                compact(spark, root, by, df, fmt)
            return
        except Conflict:
            continue  # the rows are still ours; only the manifest they go into is another


def merge_rows(
    new: DataFrame, root: str, by: Sequence[str], merge: Callable[[DataFrame], DataFrame], fmt: str = "parquet"
) -> None:
    """Read, compare and write: the places of ``new`` get ``merge`` of their current and new rows.

    If another writer comes between reading and committing, all of it is done again on what that one left.
    """
    spark = new.sparkSession
    touched = _as_places(new, by)
    while True:
        number, manifest = current(spark, root, by)
        rows = new
        if number:
            mine = read_places(spark, root, by, manifest.join(touched, list(by), "left_semi"), new, fmt)
            rows = mine.unionByName(new)
        version = _write_version(merge(rows).select(*[f"`{c}`" for c in new.columns]), root, by, fmt)
        kept = manifest.join(touched, list(by), "left_anti")
        written = _listed_places(spark, root, [version], by).select(*by)
        try:
            if _commit(spark, root, by, number, kept.unionByName(written.withColumn(VERSION, F.lit(version)))) > MAX_VERSIONS:
                compact(spark, root, by, new, fmt)
            return
        except Conflict:
            delete_path(spark, f"{root}/{VERSION}={version}")


def _commit(spark: SparkSession, root: str, by: Sequence[str], number: int, manifest: DataFrame) -> int:
    """Write the manifest, then its marker; then drop what the last two manifests don't name. Returns the live versions."""
    name = uuid.uuid4().hex
    manifest.write.parquet(f"{root}/_manifests/{name}")
    versions = [r[0] for r in _manifest_at(spark, root, name, by).select(VERSION).distinct().collect()]  # MAX_VERSIONS or so
    _claim(spark, root, number + 1, [name, *versions])
    markers = _markers(spark, root)
    if len(markers) > 2:
        for version in _live(spark, root, markers[-3:-2]) - _live(spark, root, markers[-2:]):
            delete_path(spark, f"{root}/{VERSION}={version}")
    for marker in markers[:-KEPT_MARKERS]:
        delete_path(spark, f"{root}/_manifests/{_named(spark, root, marker)[0]}")
        delete_path(spark, f"{root}/_commits/{marker}")
    return len(versions)


def _live(spark: SparkSession, root: str, markers: Sequence[str]) -> set[str]:
    """Versions that the manifests of these markers name."""
    return {v for m in markers for v in _named(spark, root, m)[1:]}


def read_places(
    spark: SparkSession, root: str, by: Sequence[str], manifest: DataFrame, like: DataFrame | None, fmt: str = "parquet"
) -> DataFrame:
    """Current rows of the places of a manifest, with the columns of ``like`` or those of the files."""
    versions = [r[0] for r in manifest.select(VERSION).distinct().collect()]  # bounded, see above
    reader = spark.read.format(fmt).option("header", "true")
    if not versions:
        if like is None:
            raise AnalysisException(f"nothing is current in {root}")
        return spark.createDataFrame([], like.schema)
    folders = [f"{root}/{VERSION}={v}" for v in versions]
    if like is not None:
        reader = reader.schema(StructType([*like.schema.fields, StructField(VERSION, StringType())]))
    rows = reader.option("basePath", root).load(folders)
    out = [f"`{c}`" for c in (rows.columns if like is None else like.columns) if c != VERSION]
    known = manifest.select(*by, VERSION)
    if _listed_places(spark, root, versions, by).join(known, [*by, VERSION], "left_anti").isEmpty():
        return rows.select(*out)  # nothing there has been replaced
    keys = [f"__{c}" for c in by]
    tagged = rows.withColumn("__version", F.col(VERSION).cast("string"))
    tagged = tagged.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in zip(keys, by, strict=True)})
    known = known.toDF(*keys, "__version")
    found = join_per_key(tagged, known, [*keys, "__version"], broadcast_bytes=BROADCAST_BYTES)
    return found.select(*out)


def read_current(spark: SparkSession, root: str, by: Sequence[str], like: DataFrame | None = None, fmt: str = "parquet") -> DataFrame:
    """All current rows of a table."""
    return read_places(spark, root, by, current(spark, root, by)[1], like, fmt)


def compact(spark: SparkSession, root: str, by: Sequence[str], like: DataFrame, fmt: str = "parquet") -> None:
    """Rewrite all current rows as one version, so that those that are mostly replaced can go."""
    number, manifest = current(spark, root, by)
    version = _write_version(read_places(spark, root, by, manifest, like, fmt), root, by, fmt)
    try:
        _commit(spark, root, by, number, manifest.withColumn(VERSION, F.lit(version)))
    except Conflict:  # the other writer's rows stay as they are; its next commit compacts
        delete_path(spark, f"{root}/{VERSION}={version}")


def drop_unused(spark: SparkSession, root: str, older_than_s: float = 86_400) -> int:
    """Delete version folders that no kept manifest names and that are older than any running writer."""
    system, where = _files(spark, root)
    live = _live(spark, root, _markers(spark, root)[-2:])
    now = spark.sparkContext._jvm.System.currentTimeMillis()
    dropped = 0
    for status in system.listStatus(where):
        name = status.getPath().getName()
        if name.startswith(f"{VERSION}=") and name.partition("=")[2] not in live and now - status.getModificationTime() >= older_than_s * 1000:
            delete_path(spark, status.getPath().toString())
            dropped += 1
    return dropped
