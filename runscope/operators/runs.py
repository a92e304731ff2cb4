"""Operators on run records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from runscope.formats import NIL_RUN_ID, UNKNOWN_DESCRIPTION
from runscope.functions.labels import hue_compose, hue_split, run_stamp
from runscope.functions.rates import host_walltime
from runscope.joins import join_per_key
from runscope.session import written


def run_enrich(
    results: DataFrame,
    timing: DataFrame,
    labels: DataFrame,
    artifacts: DataFrame,
    descriptions: DataFrame,
) -> DataFrame:
    """One row per run of ``results`` with walltime, labels, artifact hash and description.

    ``timing(run_id, started_at, ended_at)``, ``labels(run_id, name, command, config, dir,
    config_id, artifact_id)``, ``artifacts(artifact_id, md5)``, ``descriptions(config_id,
    description)``. The joins on run_id come first and share one distribution; many runs may
    have the same artifact or configuration.
    """
    labelled = results.join(timing, "run_id", "left").join(labels, "run_id", "left")
    hashed = join_per_key(labelled, artifacts, "artifact_id", "left")
    return (
        join_per_key(hashed, descriptions, "config_id", "left")
        .select(
            *[results[f"`{c}`"] for c in results.columns],
            host_walltime(F.col("started_at"), F.col("ended_at")).alias("host_walltime"),
            "name",
            "command",
            "config",
            "dir",
            F.col("md5").alias("artifact_md5"),
            run_stamp(F.col("started_at"), "report").alias("date"),
            F.col("ended_at").alias("timestamp"),
            F.coalesce("description", F.lit(UNKNOWN_DESCRIPTION)).alias("bitstream_info"),
        )
    )


def run_summary(enriched: DataFrame, sim_seconds: str = "sim_seconds") -> DataFrame:
    """One readable text per run; unknown parts show as ``-``."""

    def shown(column) -> Column:
        return F.coalesce(column.cast("string"), F.lit("-"))

    def seconds(column) -> Column:
        return F.round(column.cast("decimal(20,6)"), 2)

    benchmark, runtime, run_config, fpga = hue_split(F.col("config"))
    lines = [
        ("Finished: ", F.col("name")),
        ("Benchmark: ", benchmark),
        ("Runtime config: ", runtime),
        ("Run config: ", run_config),
        ("FPGA config: ", fpga),
        ("Host walltime (s): ", seconds(F.col("host_walltime"))),
        ("Simulated walltime (s): ", seconds(F.col(sim_seconds))),
        ("Date: ", F.col("date")),
        ("Directory: ", F.col("dir")),
        ("Command: ", F.col("command")),
    ]
    text = F.concat_ws("\n", *[F.concat(F.lit(head), shown(value)) for head, value in lines])
    return enriched.select("run_id", text.alias("text"))


def latest_pointer(
    runs: DataFrame, group: Sequence[str] = (), stamp: str = "written_at", run_id: str = "run_id"
) -> DataFrame:
    """The newest run of each group, or of all; the higher id wins a tie.

    Each task first keeps only its own newest run per group, so a hot group costs nothing.
    """
    newest_first = [F.col(stamp).desc(), F.col(run_id).desc()]
    if not group:
        return runs.orderBy(*newest_first).limit(1)
    ranked = runs.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*newest_first)))
    return ranked.where(F.col("nth") == 1).drop("nth")


def config_menu(configs: DataFrame, pattern: str = ".bit") -> DataFrame:
    """All configs ``(name, mtime)`` whose name matches the regular expression, with their rank.

    The newest has rank 1; names decide ties, so equal rows have consecutive ranks. The order is
    total over all configs: a range partitioning cuts it into pieces, written out so that all
    steps see the same cut, and a rank is the place in the piece plus the rows of earlier ones.
    """
    newest_first = [F.col("mtime").desc(), F.col("name")]
    matching = configs.where(F.col("name").rlike(pattern)).select("name", "mtime")
    pieces = written(matching.repartitionByRange(*newest_first).withColumn("piece", F.spark_partition_id()))
    # one row per partition
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy("piece")
        .agg(F.count("*").alias("rows"))
        .select("piece", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    )
    place = F.row_number().over(Window.partitionBy("piece").orderBy(*newest_first))
    return (
        pieces.withColumn("place", place)
        .join(F.broadcast(offsets), "piece")
        .select("name", "mtime", (F.col("before") + F.col("place")).alias("rank"))
    )


def sweep_grid(programs: DataFrame, axes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Every program with every combination of the listed axis values, labelled.

    ``programs`` holds some of ``program, runtime, run_config, fpga``; ``axes`` lists the
    values of the others. The lists are part of the call, so each row grows by a known
    factor and no table is joined.
    """
    grid = programs
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.withColumn(
        "label", hue_compose(*[F.col(c) for c in ("program", "runtime", "run_config", "fpga")])
    )


def coverage(grid: DataFrame, catalogue: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Which combinations of a grid (:func:`sweep_grid`) no run of the catalogue has: ``(*axes, runs)`` with 0 runs.

    ``catalogue`` has a row per run. It is counted per combination before the join, so that a combination which a third of
    all runs have is one row; NULL is a value of an axis as any other.
    """
    keys = [F.struct(F.col(a)).alias(f"__{a}") for a in axes]  # a struct of NULL equals itself
    done = catalogue.groupBy(*keys).agg(F.count("*").alias("runs"))
    expected = grid.select(*axes, *keys).distinct()
    return expected.join(done, [f"__{a}" for a in axes], "left").select(*axes, F.coalesce("runs", F.lit(0)).cast("bigint").alias("runs"))


def coverage_gaps(covered: DataFrame, axes: Sequence[str]) -> DataFrame:
    """:func:`coverage` per value of each axis: ``(axis, value, expected, missing, runs)``, and in all (axis NULL).

    All axes are rolled up by one aggregation over grouping sets. An empty grid gives no rows.
    """
    number = [F.when(F.grouping(a) == 0, F.lit(a)) for a in axes]
    value = [F.when(F.grouping(a) == 0, F.col(a).cast("string")) for a in axes]
    rolled = covered.groupingSets([*[[F.col(a)] for a in axes], []], *[F.col(a) for a in axes])
    return rolled.agg(
        F.coalesce(*number).alias("axis"), F.coalesce(*value).alias("value"), F.count("*").alias("expected"),
        F.count_if(F.col("runs") == 0).alias("missing"), F.coalesce(F.sum("runs"), F.lit(0)).cast("bigint").alias("runs"),
    ).select("axis", "value", "expected", "missing", "runs")


def run_id_assign(runs: DataFrame, column: str = "run_id") -> DataFrame:
    """A random unique id per row, written once so that it never changes afterwards."""
    return written(runs.withColumn(column, F.uuid()))


def known_run_id(run_id: Column) -> Column:
    """The id, or the nil id where there is none."""
    return F.coalesce(run_id, F.lit(NIL_RUN_ID))
