"""Operators on metrics per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from runscope.formats import CLOCK_HZ, INSTRUCTIONS, MPKI_COUNTERS
from runscope.functions.rates import cycles_to_seconds, per_kilo


def counter_final(samples: DataFrame, hz: float = CLOCK_HZ) -> DataFrame:
    """A1: last value of each counter, and the simulated seconds at that sample."""
    return (
        samples.groupBy("run_id", F.col("counter").alias("name"))
        .agg(F.max_by("value", "sample_idx").alias("value"), F.max_by("cycles", "sample_idx").alias("cycles"))
        .select("run_id", "name", "value", cycles_to_seconds(F.col("cycles"), hz).alias("seconds"))
    )


def uart_last_wins(tokens: DataFrame) -> DataFrame:
    """A2: last value of each log metric.

    Tokens read from files also have a ``block``: first the last value within each block, then
    that of the last block. Both steps order by one BIGINT and so stay hash aggregations, and
    the first has reduced a block to a row per metric before anything is shuffled.
    """
    last = F.max_by("value", "pos").alias("value")
    if "block" not in tokens.columns:
        return tokens.groupBy("run_id", "name").agg(last)
    return (
        tokens.groupBy("run_id", "name", "block")
        .agg(last)
        .groupBy("run_id", "name")
        .agg(F.max_by("value", "block").alias("value"))
    )


def metric_merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two metric sets by name; the right side wins.

    ``src`` tells the side a value came from; ``overridden`` is the left value that lost.
    Both inputs are usually grouped by the join key, and the join then adds no shuffle.
    """
    l = left.select("run_id", "name", F.col("value").cast("double").alias("l"), F.lit(True).alias("in_left"))
    r = right.select("run_id", "name", F.col("value").cast("double").alias("r"), F.lit(True).alias("in_right"))
    from_right = F.col("in_right").isNotNull()
    return l.join(r, ["run_id", "name"], "full").select(
        "run_id",
        "name",
        F.when(from_right, F.col("r")).otherwise(F.col("l")).alias("value"),
        F.when(from_right, "right").otherwise("left").alias("src"),
        F.when(from_right, F.col("l")).alias("overridden"),
    )


def instruction_counts(log_metrics: DataFrame) -> DataFrame:
    """Instructions per run as the log reports them: ``(run_id, instructions)``."""
    return log_metrics.where(F.col("name") == INSTRUCTIONS).select(
        "run_id", F.col("value").alias("instructions")
    )


def _ratio_columns(counters: Sequence[str]) -> list:
    """One aggregate per ratio, over the metrics of a run.

    The instruction count is the log's, also where a counter of the same name overrode it.
    """
    logged = F.when(F.col("src") == "left", F.col("value")).otherwise(F.col("overridden"))
    total = F.max(F.when(F.col("name") == INSTRUCTIONS, logged))
    return [
        per_kilo(F.max(F.when(F.col("name") == f"{c}_miss", F.col("value"))), total).alias(f"{c}_mpki")
        for c in counters
    ]


def mpki_final(metrics: DataFrame, counters: Sequence[str] = MPKI_COUNTERS) -> DataFrame:
    """P5: misses per thousand instructions, from :func:`metric_merge`'s output.

    Each ratio stands alone: it is NULL when its own input is missing.
    """
    return metrics.groupBy("run_id").agg(*_ratio_columns(counters))


#: Column of a wide row that has all metrics of its run.
EVERY = "every_metric"


def results_pivot(
    metrics: DataFrame, names: Sequence[str] = (), mpki_counters: Sequence[str] = (), every: bool = False
) -> DataFrame:
    """A3: one wide row per run with the listed metrics, and the ratios if asked for.

    ``names`` is explicit: the schema is fixed and one aggregation does it all. With ``every``, the column
    ``every_metric`` has all metrics of the run, whatever their names, as a VARIANT object, so runs with different
    metrics share a table; :func:`metric_at` reads one of them. A run has each metric once, so the object
    is as long as the run has names, however many samples they come from.
    """
    listed = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    if every:
        pairs = F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value"))))
        listed.append(F.to_variant_object(pairs).alias(EVERY))
    return metrics.groupBy("run_id").agg(*listed, *_ratio_columns(mpki_counters))


def metric_at(name: str, column: str = EVERY) -> Column:
    """The metric of this name in a VARIANT of all metrics, NULL where the run has none."""
    for quote in "\"'":
        if name and quote not in name:
            return F.try_variant_get(F.col(column), f"$[{quote}{name}{quote}]", "double")
    return F.try_element_at(F.col(column).try_cast("map<string,double>"), F.lit(name))  # a path can't spell it


def every_metric(results: DataFrame, column: str = EVERY) -> DataFrame:
    """The long form again: ``(run_id, name, value)`` of all metrics of all runs."""
    pairs = F.explode(F.col(column).try_cast("map<string,double>")).alias("name", "value")
    return results.select("run_id", pairs)
