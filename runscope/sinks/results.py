"""The results tree ``<root>/version=…/series=…/name=…/config=…`` (K1, K2, K3); its manifest tells the current versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import VariantType

from runscope.formats import CSV_COLUMN_NAMES
from runscope.joins import join_per_key
from runscope.sinks.snapshots import read_current, replace_places

TREE = ("series", "name", "config")


def write_table(df: DataFrame, root: str, fmt: str = "parquet", places: DataFrame | None = None) -> None:
    """Replace exactly the (series, name, config) places that ``df`` holds; of ``places`` also those that it lacks.

    The tree changes as a whole when the manifest is committed, see :mod:`runscope.sinks.snapshots`.
    """
    replace_places(df, root, TREE, places, fmt)


def write_results(df: DataFrame, root: str, fmt: str = "parquet") -> None:
    """K1: one row per run. As CSV, the columns get the names the per-run CSV files use."""
    if fmt == "csv":
        df = df.withColumnsRenamed(CSV_COLUMN_NAMES)
        df = df.withColumns({f.name: F.to_json(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, VariantType)})
    write_table(df, root, fmt)


def with_labels(table: DataFrame, labels: DataFrame, broadcast_bytes: int = 0) -> DataFrame:
    """Add the tree's columns from ``labels(run_id, series, name, config)``, one row per run.

    Runs without labels have no place in the tree and are left out.
    """
    return join_per_key(table, labels.select("run_id", *TREE), "run_id", broadcast_bytes=broadcast_bytes)


def write_raw(samples: DataFrame, root: str, fmt: str = "parquet") -> None:
    """K2: raw samples with seconds and the tree's columns."""
    write_table(samples, root, fmt)


def write_deltas(deltas: DataFrame, root: str, fmt: str = "parquet") -> None:
    """K3: deltas of counters and MPKI series with the tree's columns."""
    write_table(deltas, root, fmt)


def read_tree(spark: SparkSession, root: str, like: DataFrame | None = None, fmt: str = "parquet") -> DataFrame:
    """The tree's current rows, with the schema of the table written (``like``), so that no type is guessed."""
    return read_current(spark, root, TREE, like, fmt)
