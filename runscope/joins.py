"""Joins of many rows with a table of one row per key, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from runscope.session import file_bytes, fresh_path

# What a job broadcasts at most, by the size of its compressed files.
BROADCAST_BYTES = 64 * 1024 * 1024


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    key: str | Sequence[str],
    how: str = "inner",
    broadcast_bytes: int = 0,
) -> DataFrame:
    """``rows.join(per_key, key, how)`` where any share of ``rows`` may have the same key.

    With ``broadcast_bytes`` the small side is written and its files measured at once, and broadcast if
    it is no larger; ``rows`` is not shuffled then. (Left alone, Spark sees the small size only
    after it has started to shuffle both sides.) Otherwise Spark plans the join. If it shuffles,
    the adaptive skew join cuts a hot key's partition into pieces. That rule wants a fresh
    exchange below both sides, which a side that was just grouped by the key would not get;
    hence the small side is first distributed by something else.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if broadcast_bytes:
        spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "per-key")
        per_key.write.parquet(path)
        per_key = spark.read.schema(per_key.schema).parquet(path)
        if file_bytes(spark, path) <= broadcast_bytes:
            return rows.join(F.broadcast(per_key), keys, how)
    return rows.join(per_key.repartition(F.xxhash64(*keys)), keys, how)
