"""Operators on counter samples ``(run_id, sample_idx, cycles, counter, value)``.

A run may hold any share of all samples,
so nothing here brings a whole run into one task: order-dependent work runs on blocks of
consecutive samples.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from runscope.formats import CLOCK_HZ, CYCLES, MPKI_COUNTERS, UNBOUNDED_CYCLE, WARMUP_SAMPLES
from runscope.functions.rates import cycles_to_seconds, per_kilo
from runscope.joins import join_per_key

BLOCK_SAMPLES = 65_536
_SERIES = ("run_id", "counter")


#: Last known value before a sample and that sample's number, where a parser has told them.
PREVIOUS = ("previous", "previous_at")
#: Samples that an array is cut into where values are missing, so that looking back stays short.
LOOK_BACK = 256


def warmup_drop(samples: DataFrame, n: int = WARMUP_SAMPLES) -> DataFrame:
    """drop the first ``n`` samples of every run and renumber from 0; what was known in them is forgotten."""
    kept = samples.where(F.col("sample_idx") >= n).withColumn("sample_idx", F.col("sample_idx") - n)
    if PREVIOUS[0] not in samples.columns:
        return kept
    known = F.col("previous_at") >= n
    return kept.withColumns({"previous": F.when(known, F.col("previous")), "previous_at": F.when(known, F.col("previous_at") - n)})


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is named in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _known_before(values: Column) -> Column:
    """For each entry of an array the index of the last entry before it that is not NULL, else -1.

    The array is cut into pieces of ``LOOK_BACK``: what the earlier pieces know is carried into each,
    so an entry looks back within its own piece only.
    """
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / LOOK_BACK) - 1, F.lit(0)))

    def carried(known: Column) -> Column:
        parts = F.transform(pieces, lambda k: F.slice(known, k.cast("int") * LOOK_BACK + 1, F.lit(LOOK_BACK)))

        def joined(parts: Column) -> Column:
            last = F.transform(parts, lambda part: F.array_max(part))
            return let(
                last,
                lambda last: F.flatten(
                    F.transform(
                        parts,
                        lambda part, k: let(
                            F.coalesce(F.array_max(F.slice(last, F.lit(1), k)), F.lit(-1)),
                            # nearly always the entry just before is known; only behind a gap is there a look at all of the piece
                            lambda before: F.transform(
                                part, lambda _, i: F.coalesce(F.get(part, i - 1), F.array_max(F.slice(part, F.lit(1), i)), before)
                            ),
                        ),
                    )
                ),
            )

        return let(parts, joined)

    return let(F.transform(values, lambda v, i: F.when(v.isNotNull(), i)), carried)


def steps(runs: DataFrame, cycles: str = CYCLES) -> DataFrame:
    """``runs(run_id, counters, lines)`` → samples with what came before, all of a run from its one row.

    ``lines`` are the values of the ``counters``, sample by sample. The result is that of a parser,
    ``(run_id, sample_idx, cycles, counter, value)``, with the last known value before each sample (``previous``) and
    its number (``previous_at``). A line's predecessor is the line before it in the array; only where values are
    missing is it looked for (see :func:`_known_before`). Nothing is shuffled or sorted, and no operator
    after it has to look for a sample's predecessor.
    """
    lines = F.col("lines")
    n = F.size(lines)
    nothing = F.lit(None)

    def zipped(before: Column, at: Column) -> Column:
        return F.arrays_zip(lines.alias("line"), before.alias("before"), at.alias("at"))

    def looked_for(at: Column) -> Column:
        """From the indexes per counter and line: the values there."""
        found = F.transform(lines, lambda line, i: F.transform(line, lambda _, j: F.get(F.get(lines, F.get(F.get(at, j), i)), j)))
        return zipped(found, F.transform(lines, lambda _, i: F.transform(at, lambda of_counter: F.get(of_counter, i))))

    columns = F.sequence(F.lit(0), F.greatest(F.size("counters") - 1, F.lit(0)))
    known = F.transform(columns, lambda j: _known_before(F.transform(lines, lambda line: F.get(line, j))))
    shifted = F.concat(F.array(nothing.cast("array<bigint>")), F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0))))
    plain = zipped(F.slice(shifted, F.lit(1), n), F.array_repeat(nothing.cast("array<int>"), n))
    gaps = F.exists(lines, lambda line: F.array_size(F.array_compact(line)) < F.size(line))
    found = runs.select(
        "run_id", "counters", F.array_position("counters", cycles).cast("int").alias("c"),
        F.posexplode(F.when(gaps, let(known, looked_for)).otherwise(plain)).alias("nth", "s"),
    )
    wide = found.select(
        "run_id", F.col("nth").cast("bigint").alias("sample_idx"), F.get("s.line", F.col("c") - 1).alias("cycles"), "counters", "s.line", "s.before", "s.at"
    )
    at = F.coalesce(F.get("at", F.col("j")).cast("bigint"), F.col("sample_idx") - 1)
    return (
        # outer, as Spark would else ask for the array's size where files are read, with all of the parsing written out in that filter
        wide.select("run_id", "sample_idx", "cycles", "line", "before", "at", F.posexplode_outer("counters").alias("j", "counter"))
        .where(F.col("j").isNotNull())
        .select("run_id", "sample_idx", "cycles", "counter", F.get("line", F.col("j")).alias("value"), F.get("before", F.col("j")).alias("previous"), at.alias("at"))
        .withColumn("previous_at", F.when(F.col("at") >= 0, F.col("at")))
        .drop("at")
    )


def cycle_window(samples: DataFrame, bounds: DataFrame, broadcast_bytes: int = 0) -> DataFrame:
    """samples within ``bounds(run_id, start, end)``, both ends included, -1 = unbounded.

    Runs without bounds give no samples, nor do records without a cycle count. On
    ``broadcast_bytes`` see :func:`join_per_key`.
    """
    start, end = F.col("start"), F.col("end")
    inside = ((start == UNBOUNDED_CYCLE) | (F.col("cycles") >= start)) & (
        (end == UNBOUNDED_CYCLE) | (F.col("cycles") <= end)
    )
    bounded = join_per_key(
        samples.drop(*PREVIOUS), bounds.select("run_id", "start", "end"), "run_id", broadcast_bytes=broadcast_bytes
    )
    return bounded.where(inside).drop("start", "end")


def with_previous(samples: DataFrame, block: int = BLOCK_SAMPLES) -> DataFrame:
    """Add ``previous``, the last known value before a sample, NULL if there is none.

    Samples that their parser has told it of keep it, see :func:`steps`; the others are shuffled for it. Samples without a value are passed over, and indexes may have gaps. Rows are distributed by
    (series, block of consecutive samples), so a long series spreads over many tasks. The same
    distribution gives the last value of each block; the few of those are carried on to the blocks
    behind.
    """
    if PREVIOUS[0] in samples.columns:
        return samples.drop(PREVIOUS[1])
    key = [*_SERIES, "block"]
    tagged = samples.withColumn("block", F.expr(f"sample_idx div {block}")).repartition(*key)
    before = Window.partitionBy(*key).orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*_SERIES).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known_at = F.when(F.col("value").isNotNull(), F.col("sample_idx"))
    carried = (
        tagged.groupBy(*key)
        .agg(F.max_by("value", known_at).alias("value"))
        .select(*key, F.last("value", ignorenulls=True).over(earlier).alias("carried"))
        .where(F.col("carried").isNotNull())
    )
    return (
        tagged.withColumn("previous", F.last("value", ignorenulls=True).over(before))
        .join(carried, key, "left")
        .withColumn("previous", F.coalesce("previous", "carried"))
        .drop("block", "carried")
    )


def _difference(value: Column, previous: Column) -> Column:
    """Exact BIGINT difference as DOUBLE; the doubles' difference should it overflow."""
    return F.coalesce(
        F.try_subtract(value, previous).cast("double"), value.cast("double") - previous.cast("double")
    )


def _step(value: Column, previous: Column) -> Column:
    """What a counter gained since its last known value: 0 at the first, NULL where it is unknown."""
    gained = F.when(value.isNotNull(), F.coalesce(_difference(value, previous), F.lit(0.0)))
    return F.when(F.col("counter") == CYCLES, value.cast("double")).otherwise(gained)


def counter_delta(samples: DataFrame, hz: float = CLOCK_HZ, **blocks) -> DataFrame:
    """``seconds`` and ``delta`` per sample; first row 0, the cycle counter undiffed.

    A sample without a value has none; the next one gets all that was gained meanwhile.
    """
    delta = _step(F.col("value"), F.col("previous"))
    return (
        with_previous(samples, **blocks)
        .withColumn("seconds", cycles_to_seconds(F.col("cycles"), hz))
        .withColumn("delta", delta)
        .drop("previous")
    )


def _ratio_names(counters: Sequence[str]) -> Column:
    """Series name of a miss counter, NULL for other counters."""
    names = F.create_map(*[F.lit(x) for c in counters for x in (f"{c}_miss", f"mpki_{c}")])
    return F.element_at(names, F.col("counter"))


def mpki_series(
    samples: DataFrame,
    instructions: DataFrame,
    counters: Sequence[str] = MPKI_COUNTERS,
    broadcast_bytes: int = 0,
) -> DataFrame:
    """Cumulative misses per thousand instructions of the *whole* run, per sample.

    ``instructions(run_id, instructions)`` has one row per run. NULL where the run has no
    instructions.
    """
    misses = samples.where(F.col("counter").isin(*[f"{c}_miss" for c in counters]))
    return join_per_key(misses, instructions, "run_id", "left", broadcast_bytes).select(
        "run_id",
        "sample_idx",
        _ratio_names(counters).alias("counter"),
        per_kilo(F.col("value"), F.col("instructions")).alias("mpki"),
    )


def delta_table(
    samples: DataFrame,
    runs: DataFrame,
    counters: Sequence[str] = MPKI_COUNTERS,
    hz: float = CLOCK_HZ,
    how: str = "left",
    broadcast_bytes: int = 0,
    **blocks,
) -> DataFrame:
    """Deltas of all counters and of their MPKI series: ``(run_id, sample_idx, seconds, counter, delta)``.

    ``runs`` has one row per run with ``instructions``; its other columns are passed on. Counter
    and ratio come from the same predecessor, hence from one shuffle. All that is known per run
    arrives in one join, because the adaptive skew join splits a hot run only in a join whose
    distribution nothing above it relies on.
    """
    value, previous, total = F.col("value"), F.col("previous"), F.col("instructions")
    step = _step(value, previous)
    ratio = per_kilo(value, total)
    ratio_step = F.when(
        ratio.isNotNull(), F.coalesce(ratio - per_kilo(previous, total), F.lit(0.0))
    )
    name = _ratio_names(counters)
    plain = F.struct(F.col("counter"), step.alias("delta"))
    derived = F.struct(name.alias("counter"), ratio_step.alias("delta"))
    passed_on = [c for c in runs.columns if c not in ("run_id", "instructions")]
    return (
        join_per_key(with_previous(samples, **blocks), runs, "run_id", how, broadcast_bytes)
        .select(
            "run_id",
            "sample_idx",
            cycles_to_seconds(F.col("cycles"), hz).alias("seconds"),
            F.explode_outer(F.when(name.isNull(), F.array(plain)).otherwise(F.array(plain, derived))).alias("d"),
            *passed_on,
        )
        .select("run_id", "sample_idx", "seconds", "d.counter", "d.delta", *passed_on)
    )


def raw_table(samples: DataFrame, hz: float = CLOCK_HZ) -> DataFrame:
    """The raw samples with their ``seconds``."""
    return samples.drop(*PREVIOUS).withColumn("seconds", cycles_to_seconds(F.col("cycles"), hz))


def plot_series(deltas: DataFrame) -> DataFrame:
    """(seconds, delta) points per counter, without the cycle counter itself."""
    return deltas.where(F.col("counter") != CYCLES).select("run_id", "counter", "seconds", "delta")


def wide_samples(table: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    """One row per sample, one column per listed counter."""
    return table.groupBy("run_id", "sample_idx", "seconds").agg(
        *[F.max(F.when(F.col("counter") == name, F.col(value))).alias(name) for name in names]
    )
