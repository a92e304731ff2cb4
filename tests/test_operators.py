"""Operators on small tables: odd values, laws, and hot runs against brute force."""

import datetime as dt
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runscope.formats import BATCH_RULES, CONFIG_FIELDS, CYCLES, NIL_RUN_ID, Rule
from runscope.functions import labels as lab
from runscope.functions.rates import host_walltime
from runscope.functions.text import run_name_valid
from runscope.joins import join_per_key
from runscope.operators import configs, metrics, runs, series, traces
from runscope.plans.postrun import mpki_report

SAMPLE = "run_id string, sample_idx bigint, cycles bigint, counter string, value bigint"


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column).first()[0]


@pytest.mark.parametrize(
    "hue, parts",
    [("a.b.c.d", ["a", "b", "c", "d"]), ("a.b.c", ["a", "b", "c", None]), ("a.b.c.d.e", ["a", "b", "c", "d"]), ("", ["", None, None, None])],
)
def test_hue_split(spark, hue, parts):
    assert list(spark.range(1).select(*lab.hue_split(F.lit(hue))).first()) == parts


def test_hue_round_trip(spark):
    composed = lab.hue_compose(*[F.lit(p) for p in ("ycsb-a", "yk", "", "cfg-1")])
    assert list(spark.range(1).select(*lab.hue_split(composed)).first()) == ["ycsb-a", "yk", "", "cfg-1"]


@pytest.mark.parametrize(
    "name, valid",
    [("run-1_a.B", True), ("", False), ("a b", False), ("a/b", False), ("a:b", False), ("abc\n", False), ("é", False), (None, False)],
)
def test_run_names(spark, name, valid):
    assert one(spark, run_name_valid(F.col("n").cast("string")), n=name) is valid


@pytest.mark.parametrize("style", sorted(lab.STAMP_STYLES))
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_stamps(spark, style, zone):
    # the second does not exist in New York's local time, and is a valid naive stamp all the same
    for stamp in (dt.datetime(2024, 2, 29, 23, 5, 9), dt.datetime(2024, 3, 10, 2, 30, 0)):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            naive = F.lit(stamp.isoformat()).cast("timestamp_ntz")
            text = one(spark, lab.run_stamp(naive, style), x=1)
            assert text == stamp.strftime(lab.STAMP_STYLES[style])
            parsed = one(spark, lab.parse_stamp(F.lit(text), style), x=1)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert parsed == dt.datetime.strptime(text, lab.STAMP_STYLES[style])


def test_bad_stamps(spark):
    for text in ("", "2024-13-01000000", "2024-01-01-000000", "2024-01-01250000", None):
        assert one(spark, lab.parse_stamp(F.lit(text).cast("string"), "run"), x=1) is None


def test_walltime_ignores_time_zones(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        a, b = (F.lit(t).cast("timestamp_ntz") for t in ("2024-03-10 01:00:00", "2024-03-10 04:00:00.5"))
        assert one(spark, host_walltime(a, b), x=1) == 10800.5
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_command_string_stays_as_it_is(spark):
    assert one(spark, lab.command_text(F.col("c")), c="echo from srun; ls -lah") == "echo from srun; ls -lah"


def test_commands(spark):
    words = F.split(F.lit("a|b c"), "[|]")
    assert one(spark, lab.command_text(words, "\n"), x=1) == "a\nb c"
    assert one(spark, lab.command_text(words, " ; "), x=1) == "a ; b c"
    assert one(spark, lab.command_text(F.array().cast("array<string>"), " "), x=1) is None
    assert one(spark, lab.command_text(F.lit("")), x=1) is None
    kinds = [
        tuple(spark.range(1).select(*lab.job_kind(F.lit(c).cast("string"), F.lit("r"))).first())
        for c in (None, "", " ", "ls")
    ]
    assert kinds == [(True, "r-interactive"), (True, "r-interactive"), (False, "r"), (False, "r")]


def test_paths(spark):
    assert one(spark, lab.result_path(F.lit("s"), F.lit("n"), F.lit("a.b.c.d")), x=1) == "results/s/n/a.b.c.d/"
    assert one(spark, lab.log_path(F.lit("slurm-log/%j.out"), F.lit(-1)), x=1) == "slurm-log/-1.out"


# --- samples --------------------------------------------------------------------------

def make_samples(spark, lengths, names=(CYCLES, "l1_htlb_miss", "other"), seed=1):
    rng = random.Random(seed)
    rows = []
    for run, length in lengths.items():
        for name in names:
            total = 0
            for i in range(length):
                total += rng.randrange(1000)
                rows.append((run, i, (i + 1) * 100, name, (i + 1) * 100 if name == CYCLES else total))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SAMPLE).repartition(8)


def brute_deltas(rows):
    values = {(r, c, i): v for r, i, _, c, v in rows}
    out = {}
    for r, i, _, c, v in rows:
        previous = values.get((r, c, i - 1))
        out[(r, c, i)] = float(v) if c == CYCLES else float(v - previous) if previous is not None else 0.0
    return out


@pytest.mark.parametrize("block", [1, 2, 7, 65_536])
def test_deltas_of_a_hot_run(spark, block):
    rows, samples = make_samples(spark, {"hot": 300, "a": 1, "b": 7, "c": 8, "d": 14})
    got = series.counter_delta(samples, block=block).collect()
    assert {(r.run_id, r.counter, r.sample_idx): r.delta for r in got} == brute_deltas(rows)
    assert len(got) == len(rows)


@pytest.mark.parametrize("block", [1, 3, 10])
def test_deltas_with_gaps(spark, block):
    rows, _ = make_samples(spark, {"hot": 120, "a": 9})
    kept = [r for r in rows if (r[1] * 7) % 5 in (0, 3) or r[1] > 100]
    want, last = {}, {}
    for r, i, _, c, v in sorted(kept, key=lambda x: x[1]):
        want[(r, c, i)] = float(v) if c == CYCLES else float(v - last.get((r, c), v))
        last[(r, c)] = v
    frame = spark.createDataFrame(kept, SAMPLE)
    got = series.counter_delta(frame, block=block).collect()
    assert {(r.run_id, r.counter, r.sample_idx): r.delta for r in got} == want


def test_blocks_are_part_of_the_distribution(spark):
    _, samples = make_samples(spark, {"hot": 10})
    plan = series.counter_delta(samples)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(run_id" in line]
    by_series = [line for line in exchanges if "block" not in line]
    assert len(exchanges) > len(by_series) == 1  # the last values of the blocks, a row per block


def test_delta_is_exact_and_survives_overflow(spark):
    rows = [("r", i, i, "x", v) for i, v in enumerate([2**60, 2**60 + 3, -(2**62), 2**62 + 2**61, None, 5])]
    got = series.counter_delta(spark.createDataFrame(rows, SAMPLE)).orderBy("sample_idx").collect()
    assert [r.delta for r in got] == [0.0, 3.0, float(-(2**62) - 2**60 - 3), float(2**63 + 2**61), None, float(5 - 2**62 - 2**61)]


def test_deltas_sum_to_last_minus_first(spark):
    rows, samples = make_samples(spark, {"a": 50, "b": 3})
    got = series.counter_delta(samples, block=8).where(F.col("counter") != CYCLES)
    sums = {(r.run_id, r.counter): r.s for r in got.groupBy("run_id", "counter").agg(F.sum("delta").alias("s")).collect()}
    values = {(r, c, i): v for r, i, _, c, v in rows}
    last = {"a": 49, "b": 2}
    assert sums == {(r, c): values[(r, c, last[r])] - values[(r, c, 0)] for r, c in sums}


def test_delta_table_has_ratio_deltas(spark):
    rows = [("r", i, i, "l1_htlb_miss", v) for i, v in enumerate([10, 30, 60])] + [("z", 0, 0, "l1_htlb_miss", 4), ("z", 1, 1, "l1_htlb_miss", 9)]
    per_run = spark.createDataFrame([("r", 2000.0, "s"), ("z", 0.0, "s")], "run_id string, instructions double, series string")
    got = series.delta_table(spark.createDataFrame(rows, SAMPLE), per_run).orderBy("run_id", "counter", "sample_idx").collect()
    assert [(r.run_id, r.counter, r.delta) for r in got] == [
        ("r", "l1_htlb_miss", 0.0), ("r", "l1_htlb_miss", 20.0), ("r", "l1_htlb_miss", 30.0),
        ("r", "mpki_l1_htlb", 0.0), ("r", "mpki_l1_htlb", 10.0), ("r", "mpki_l1_htlb", 15.0),
        ("z", "l1_htlb_miss", 0.0), ("z", "l1_htlb_miss", 5.0),
        ("z", "mpki_l1_htlb", None), ("z", "mpki_l1_htlb", None),
    ]
    points = series.plot_series(series.delta_table(spark.createDataFrame(rows, SAMPLE), per_run))
    assert points.columns == ["run_id", "counter", "seconds", "delta"] and points.count() == 10


def test_warm_up(spark):
    _, samples = make_samples(spark, {"six": 6, "seven": 7}, names=("x",))
    got = series.warmup_drop(samples).collect()
    assert [(r.run_id, r.sample_idx, r.cycles) for r in got] == [("seven", 0, 700)]


def test_cycle_window(spark):
    _, samples = make_samples(spark, {r: 5 for r in "abcde"}, names=("x",))
    bounds = spark.createDataFrame(
        [("a", 200, 300), ("b", -1, 200), ("c", 400, -1), ("d", -1, -1)], "run_id string, start bigint, end bigint"
    )
    got = Counter(r.run_id for r in series.cycle_window(samples, bounds).collect())
    assert got == {"a": 2, "b": 2, "c": 2, "d": 5}


def test_wide_samples(spark):
    _, samples = make_samples(spark, {"a": 4, "b": 2}, names=("x", "y"))
    wide = series.wide_samples(series.raw_table(samples), ["x", "y"], "value")
    assert wide.columns == ["run_id", "sample_idx", "seconds", "x", "y"] and wide.count() == 6


# --- metrics --------------------------------------------------------------------------

METRIC = "run_id bigint, name string, value double"


def test_merge_right_wins(spark):
    left = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], METRIC)
    right = spark.createDataFrame([(1, "b", 9.0), (3, "a", None)], METRIC)
    got = {(r.run_id, r.name): (r.value, r.src, r.overridden) for r in metrics.metric_merge(left, right).collect()}
    assert got == {
        (1, "a"): (1.0, "left", None), (1, "b"): (9.0, "right", 2.0),
        (2, "a"): (3.0, "left", None), (3, "a"): (None, "right", None),
    }


def test_merge_with_an_empty_side_is_the_identity(spark):
    rows = [(1, "a", 1.0), (1, "b", 2.0)]
    full, empty = spark.createDataFrame(rows, METRIC), spark.createDataFrame([], METRIC)
    for merged in (metrics.metric_merge(full, empty), metrics.metric_merge(empty, full)):
        assert sorted((r.run_id, r.name, r.value) for r in merged.collect()) == rows


def test_mpki_takes_the_logs_instructions(spark):
    log = spark.createDataFrame([(1, "instructions", 2000.0), (2, "instructions", 0.0), (4, "instructions", 500.0)], METRIC)
    counted = spark.createDataFrame(
        [(1, "instructions", 7.0), (1, "l1_htlb_miss", 8.0), (2, "l1_htlb_miss", 8.0), (3, "l1_htlb_miss", 8.0), (3, "instructions", 9.0)], METRIC
    )
    got = {r.run_id: (r.l1_htlb_mpki, r.l2_htlb_mpki) for r in metrics.mpki_final(metrics.metric_merge(log, counted)).collect()}
    assert got == {1: (4.0, None), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_report_drops_the_warm_up(spark):
    tokens = spark.createDataFrame([("a", 0, "instructions", 1000.0)], "run_id string, pos bigint, name string, value double")
    samples = spark.createDataFrame([("a", i, i, "l1_tlb_miss", i * 10) for i in range(8)], SAMPLE)
    short = spark.createDataFrame([("b", i, i, "l1_tlb_miss", i) for i in range(6)], SAMPLE)
    got = {r.run_id: r.l1_tlb_mpki for r in mpki_report(tokens, samples.union(short)).collect()}
    assert got == {"a": 70.0}


# --- runs -----------------------------------------------------------------------------

def test_latest_breaks_ties_by_id_and_gives_one_row_per_group(spark):
    day = dt.datetime(2024, 1, 1)
    frame = spark.createDataFrame(
        [(1, "a", day), (2, "a", day), (3, "b", day), (4, "b", dt.datetime(2023, 1, 1)), (5, None, day)],
        "run_id bigint, name string, written_at timestamp_ntz",
    )
    assert sorted(r.run_id for r in runs.latest_pointer(frame, ("name",)).collect()) == [2, 3, 5]
    assert [r.run_id for r in runs.latest_pointer(frame).collect()] == [5]


def test_menu(spark):
    frame = spark.createDataFrame([("abit", 1), ("bit", 9), ("x.bit", 2), ("b.bits", 2)], "name string, mtime bigint")
    got = {r.rank: r.name for r in runs.config_menu(frame).collect()}
    assert got == {1: "b.bits", 2: "x.bit", 3: "abit"}
    many = spark.range(5000).select(F.concat(F.lit("c"), F.col("id"), F.lit(".bit")).alias("name"), (F.col("id") * 7 % 100).alias("mtime"))
    rows = runs.config_menu(many).collect()
    want = sorted(((f"c{i}.bit", i * 7 % 100) for i in range(5000)), key=lambda r: (-r[1], r[0]))
    assert [(r.name, r.mtime) for r in sorted(rows, key=lambda r: r["rank"])] == want


@pytest.mark.parametrize("block", [1, 2, 3, 65_536])
def test_bad_cells_lose_no_increment(spark, block):
    values = [None, 10, 20, None, None, None, 40, 50, None]
    rows = [("r", i, i, "l1_htlb_miss", v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, SAMPLE)
    got = series.counter_delta(frame, block=block).orderBy("sample_idx").collect()
    assert [r.delta for r in got] == [None, 0.0, 10.0, None, None, None, 20.0, 10.0, None]
    per_run = spark.createDataFrame([("r", 1000.0)], "run_id string, instructions double")
    table = series.delta_table(frame, per_run, block=block).where("counter like 'mpki%'").orderBy("sample_idx").collect()
    assert [r.delta for r in table] == [None, 0.0, 10.0, None, None, None, 20.0, 10.0, None]


def test_grid(spark):
    programs = spark.createDataFrame([("p",), ("q",)], "program string")
    grid = runs.sweep_grid(programs, {"runtime": ["x", "y"], "run_config": ["r"], "fpga": ["f"]})
    assert sorted(r.label for r in grid.collect()) == ["p.x.r.f", "p.y.r.f", "q.x.r.f", "q.y.r.f"]


def test_run_ids_are_unique_and_stay(spark):
    frame = runs.run_id_assign(spark.range(1000))
    first = {r.id: r.run_id for r in frame.collect()}
    assert first == {r.id: r.run_id for r in frame.collect()}
    assert len(set(first.values())) == 1000 and all(uuid.UUID(v).version == 4 for v in first.values())
    assert one(spark, runs.known_run_id(F.lit(None).cast("string")), x=1) == NIL_RUN_ID


def test_summary_of_a_run_without_timing(spark):
    frame = spark.createDataFrame(
        [("r", "bench", "ls", "a.b.c.d", "/", None, 0.1, None)],
        "run_id string, name string, command string, config string, dir string, host_walltime double, sim_seconds double, date string",
    )
    text = runs.run_summary(frame).first().text
    assert text.splitlines() == [
        "Finished: bench", "Benchmark: a", "Runtime config: b", "Run config: c", "FPGA config: d",
        "Host walltime (s): -", "Simulated walltime (s): 0.10", "Date: -", "Directory: /", "Command: ls",
    ]


# --- configurations -------------------------------------------------------------------

def test_overlay(spark):
    base = spark.createDataFrame([(1, "a", True, 3), (2, "b", True, 3)], "run_id bigint, name string, flag boolean, n int")
    override = spark.createDataFrame(
        [(1, None, False, 0, "p", None), (3, "z", None, None, None, "q")],
        "run_id bigint, name string, flag boolean, n bigint, extra string, more string",
    )
    got = configs.config_overlay(base, override)
    assert got.schema["n"].dataType == base.schema["n"].dataType
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", False, 0, ["extra"]), (2, "b", True, 3, [])]


def test_overlay_of_listed_fields_only(spark):
    base = spark.createDataFrame([(1, "a", 1)], "run_id bigint, name string, n int")
    override = spark.createDataFrame([(1, "z", 5)], "run_id bigint, name string, n int")
    assert tuple(configs.config_overlay(base, override, ["n"]).first()) == (1, "a", 5, ["name"])


def test_overlay_of_a_configuration_record(spark):
    """Flags that are no fields of the record change nothing and are listed."""
    record = ("overlay", "configs", "latest", "root.img", "kernel.bin", "logs", "results", ["p1"], ["n1"], 0, False)
    base = spark.createDataFrame([("r", *record)], f"run_id string, {CONFIG_FIELDS}")
    flags = spark.createDataFrame(
        [("r", "other.img", None, 2, True, "p2", "n2", -1)],
        "run_id string, sim_img string, log_dir string, verbosity int, dry_run boolean,"
        " partition_flag string, nodelist_flag string, print_start int",
    )
    got = configs.config_overlay(base, flags).first().asDict()
    changed = {k: v for k, v in got.items() if k in base.columns and v != base.first()[k]}
    assert changed == {"sim_img": "other.img", "verbosity": 2, "dry_run": True}
    assert got["ignored"] == ["partition_flag", "nodelist_flag", "print_start"]


MEMBER = "config_id string, member string, kind string, file_name string, readable boolean, writable boolean, executable boolean"


def test_complete_configurations(spark):
    good = {
        "config_dir": ("dir", "c"), "bitstream_dir": ("dir", "x"), "driver": ("file", "d"), "bitstream": ("file", "f.bit"),
        "overlay": ("dir", "o"), "image": ("file", "root.img"), "program": ("file", "k.bin"), "results_dir": ("dir", "r"),
    }
    rows = [("ok", m, k, n, True, True, True) for m, (k, n) in good.items()]
    rows += [("raw", m, k, n.replace(".img", ".raw"), True, m != "results_dir", m != "driver") for m, (k, n) in good.items()]
    rows += [("hidden", m, k, "/x/.img", True, True, True) for m, (k, n) in good.items()]
    rows += [("none", "driver", "file", "d", None, True, True)]
    got = {r.config_id: (r.complete, r.failed) for r in configs.config_complete(spark.createDataFrame(rows, MEMBER), BATCH_RULES).collect()}
    assert got == {"ok": (True, []), "raw": (False, ["driver", "image", "results_dir"]), "hidden": (False, ["image"]), "none": (False, list(good))}


def test_a_configuration_without_rows_fails(spark):
    manifest = spark.createDataFrame([("a", "m", True)], "config_id string, member string, readable boolean")
    every = spark.createDataFrame([("a",), ("b",)], "config_id string")
    got = configs.config_complete(manifest, [Rule("m", readable=True)], every).collect()
    assert {r.config_id: (r.complete, r.failed) for r in got} == {"a": (True, []), "b": (False, ["m"])}


def test_any_matching_row_satisfies_a_rule(spark):
    rows = [("c", "driver", "file", "a", True, True, False), ("c", "driver", "file", "b", True, True, True)]
    verdict = configs.config_complete(spark.createDataFrame(rows, MEMBER), [Rule("driver", readable=True, executable=True)])
    assert verdict.first().complete
    jobs = spark.createDataFrame([(1, "c", "ls"), (2, "c", ""), (3, "c", None), (4, "d", "ls")], "run_id bigint, config_id string, cmd string")
    assert [r.run_id for r in configs.batch_eligible(jobs, verdict).collect()] == [1]


# --- traces ---------------------------------------------------------------------------

def test_slices(spark):
    marks = {"a": "..S.E.E", "b": "E.S.", "c": "E..", "d": "SES.E", "e": "X.E", "f": "..S"}
    rows = [(run, i, m) for run, text in marks.items() for i, m in enumerate(text)]
    events = spark.createDataFrame(rows, "run_id string, pos bigint, m string").repartition(4)
    got = traces.roi_slice(events, F.col("m").isin("S", "X"), F.col("m").isin("E", "X"), "pos").orderBy("run_id", "pos").collect()
    slices = {}
    for r in got:
        slices[r.run_id] = slices.get(r.run_id, "") + r.m
    assert slices == {"a": "S.E", "b": "S.", "d": "SE", "e": "X.E", "f": "S"}


@pytest.mark.parametrize("keys_per_task", [1_000_000, 20, 0])
def test_histogram_of_a_hot_run(spark, keys_per_task):
    rng = random.Random(5)
    rows = [("hot", f"k{int(rng.paretovariate(0.4)) % 700}") for _ in range(6000)]
    rows += [(f"r{i % 9}", f"k{rng.randrange(15)}") for i in range(900)]
    want = {}
    for run in {r for r, _ in rows}:
        counts = Counter(k for r, k in rows if r == run)
        for rank, (key, n) in enumerate(sorted(counts.items(), key=lambda kv: (-kv[1], kv[0])), 1):
            want[(run, key)] = (n, rank)
    trace = spark.createDataFrame(rows, "run_id string, key string").repartition(8)
    got = traces.trace_histogram(trace, keys_per_task=keys_per_task).collect()
    assert {(r.run_id, r.key): (r.n, r["rank"]) for r in got} == want and len(got) == len(want)


def test_hot_run_is_split_in_a_join_by_run(spark):
    """With a third of all samples in one run and no broadcast, the join splits that run."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.shuffle.partitions": "20",
    }
    old = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        n = F.col("id")
        samples = spark.range(300_000).select(
            F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), n % 2000)).alias("run_id"),
            F.floor(n / 3).alias("sample_idx"),
            n.alias("cycles"),
            F.lit("l1_htlb_miss").alias("counter"),
            n.alias("value"),
        )
        per_run = samples.select("run_id").distinct().withColumn("instructions", F.lit(1000.0))
        for frame in (
            series.mpki_series(samples, per_run),
            series.delta_table(samples, per_run, block=1000),
        ):
            assert len(frame.collect()) in (300_000, 600_000)
            assert "SortMergeJoin(skew=true)" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_checked_broadcast(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("run_id"), "id")
    per_run = spark.range(5).select(F.col("id").alias("run_id"), F.lit(1).alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit, hinted in ((100_000, True), (100, False), (0, False)):
            joined = join_per_key(rows, per_run, "run_id", "left", broadcast_bytes=limit)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) is hinted
            assert joined.count() == 100 and joined.where("x = 1").count() == 72
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_runs_of_common_length_are_dealt_out_once(spark):
    rows = [(r, f"k{i % 7}") for r in (1, 2, None) for i in range(20)]
    got = traces.trace_histogram(spark.createDataFrame(rows, "run_id bigint, key string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(run_id") == 1 and "Exchange hashpartitioning(run_id, key" not in plan
    assert sorted((r.run_id or 0, r.key, r.n, r["rank"]) for r in got.collect() if r["rank"] < 2) == [(0, "k0", 3, 1), (1, "k0", 3, 1), (2, "k0", 3, 1)]
    # longer runs, one of them without an id, take the other way to the same result
    split = traces.trace_histogram(spark.createDataFrame(rows + [(5, "x")], "run_id bigint, key string"), keys_per_task=19)
    as_set = lambda df: {tuple(r) for r in df.where("run_id is null or run_id < 5").collect()}
    assert as_set(split) == as_set(got) and split.where("run_id = 5").count() == 1
