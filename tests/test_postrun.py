"""From run files to the results tree."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from runscope.formats import CYCLES
from runscope.operators.series import wide_samples
from runscope.plans.postrun import LATEST_BY, analyse
from runscope.sinks.results import TREE, read_tree, write_results
from runscope.sinks.snapshots import read_current
from runscope.sources.files import artifact_md5, read_artifacts
from runscope.sources.logs import description_scan, read_descriptions

NAMES = ["instructions", "error", "l1_htlb_miss"]


@pytest.fixture
def run_tree(tmp_path):
    """Finished runs: complete, too short for samples, without instructions, without anything."""
    for run, rows, log in (
        ("a2024-01-01120000", 9, "x YUKON_INSTRUCTIONS=1000 YUKON_ERROR_A=3\nYUKON_ERROR_B=4 YUKON_INSTRUCTIONS=2000\n"),
        ("b2024-01-01130000", 5, "YUKON_INSTRUCTIONS=1000\n"),
        ("c2024-01-01140000", 8, "nothing here\nYUKON_ERROR=1\n"),
        ("d2024-01-01150000", 0, ""),
    ):
        folder = tmp_path / "logs" / run
        folder.mkdir(parents=True)
        (folder / "uartlog").write_text(log)
        head = f"a\nb\nc\ndescription,{CYCLES},l1_htlb_miss\nt\nw\naw\n"
        lines = "".join(f"x,{(i + 1) * 10**8},{i * i * 10}\n" for i in range(rows))
        (folder / "AUTOCOUNTERFILE0.csv").write_text(head + lines)
    for config, text in (("cfg1", " first \n"), ("cfg2", "second")):
        (tmp_path / "configs" / config).mkdir(parents=True)
        (tmp_path / "configs" / config / "description.txt").write_text(text)
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "lib.so").write_bytes(b"abc")
    return tmp_path


def side_tables(spark, root):
    artifacts = artifact_md5(read_artifacts(spark, f"{root}/lib"))
    lib = artifacts.first().artifact_id
    start = dt.datetime(2024, 1, 1, 12)
    ids = ["a2024-01-01120000", "b2024-01-01130000", "c2024-01-01140000", "d2024-01-01150000"]
    timing = spark.createDataFrame(
        [(ids[0], start, start + dt.timedelta(seconds=2.5))], "run_id string, started_at timestamp_ntz, ended_at timestamp_ntz"
    )
    labels = spark.createDataFrame(
        [(i, "series1", f"bench{n % 2}", "ls", f"p.rt.rc.f{n}", "/", f"cfg{n + 1}", lib) for n, i in enumerate(ids)],
        "run_id string, series string, name string, command string, config string, dir string, config_id string, artifact_id string",
    )
    descriptions = description_scan(read_descriptions(spark, f"{root}/configs/*/description.txt"))
    return timing, labels, artifacts, descriptions


def test_results_tree_of_finished_runs(spark, run_tree):
    out = str(run_tree / "results")
    analyse(spark, f"{run_tree}/logs/*", out, NAMES, *side_tables(spark, run_tree))
    rows = {r.run_id[0]: r for r in read_tree(spark, f"{out}/results").collect()}
    a, b, c, d = (rows[x] for x in "abcd")
    assert (d.instructions, d.l1_htlb_miss, d.command) == (None, None, "ls")
    assert (a.instructions, a.error, a.l1_htlb_miss, a.l1_htlb_mpki, a.l2_tlb_mpki) == (2000.0, 4.0, 640.0, 320.0, None)
    assert (a.host_walltime, a.sim_seconds, a.date) == (2.5, 0.9, "2024-01-01-120000")
    assert (a.bitstream_info, b.bitstream_info, c.bitstream_info) == ("first", "second", "Unk.")
    assert a.artifact_md5 == "900150983cd24fb0d6963f7d28e17f72"
    assert (b.instructions, b.l1_htlb_miss, b.l1_htlb_mpki, b.sim_seconds) == (1000.0, None, None, None)
    assert (c.l1_htlb_miss, c.l1_htlb_mpki, c.host_walltime) == (490.0, None, None)
    assert sorted(d.name for d in next((run_tree / "results" / "results").glob("version=*/series=series1")).iterdir()) == ["name=bench0", "name=bench1"]

    raw = read_tree(spark, f"{out}/raw").where("run_id like 'a%'")
    got = wide_samples(raw, [CYCLES, "l1_htlb_miss"], "value").orderBy("sample_idx").collect()
    assert [tuple(r) for r in got] == [("a2024-01-01120000", i, (i + 7) / 10, (i + 7) * 10**8, (i + 6) ** 2 * 10) for i in range(3)]

    deltas = read_tree(spark, f"{out}/deltas").where("run_id like 'a%'").orderBy("counter", "sample_idx").collect()
    assert [(r.counter, r.delta) for r in deltas] == [
        (CYCLES, 7e8), (CYCLES, 8e8), (CYCLES, 9e8),
        ("l1_htlb_miss", 0.0), ("l1_htlb_miss", 130.0), ("l1_htlb_miss", 150.0),
        ("mpki_l1_htlb", 0.0), ("mpki_l1_htlb", 65.0), ("mpki_l1_htlb", 75.0),
    ]


def test_writing_a_configuration_again_replaces_only_its_partition(spark, tmp_path):
    root = str(tmp_path / "tree")
    frame = spark.createDataFrame(
        [(1, "s", "n", "a", 1.0), (2, "s", "n", "a", 2.0), (3, "s", "n", "007", 3.0)],
        "run_id bigint, series string, name string, config string, v double",
    )
    write_results(frame, root)
    write_results(frame.where("run_id = 2").withColumn("v", F.lit(9.0)), root)
    assert sorted(tuple(r) for r in read_tree(spark, root, frame).collect()) == [(2, "s", "n", "a", 9.0), (3, "s", "n", "007", 3.0)]


def test_rebalance_is_planned_and_splits_a_hot_partition(spark, tmp_path):
    changed = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        n = F.col("id")
        frame = spark.range(0, 90_000, 1, 12).select(
            n.alias("run_id"),
            F.lit("s").alias("series"),
            F.lit("n").alias("name"),
            F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), n % 20)).alias("config"),
            F.rand(1).alias("v"),
        )
        root = tmp_path / "tree"
        write_results(frame, str(root))
        files = {d.name: len(list(d.glob("*.parquet"))) for d in root.glob("version=*/series=s/name=n/*")}
        assert files["config=hot"] > 3
        assert read_tree(spark, str(root), frame).count() == 90_000
    finally:
        for k in changed:
            spark.conf.unset(k)


def test_csv_results_have_the_usual_column_names(spark, tmp_path):
    root = str(tmp_path / "csv")
    frame = spark.createDataFrame(
        [(1, "s", "n", "c", "h", "d, e")],
        "run_id bigint, series string, name string, config string, artifact_md5 string, bitstream_info string",
    )
    write_results(frame, root, "csv")
    back = spark.read.option("header", "true").csv(root)
    assert back.columns[:3] == ["run_id", "libyukon_md5", "bitstream info"]
    assert back.first()["bitstream info"] == "d, e"


def one_run(root, run, rows, log="YUKON_INSTRUCTIONS=1000 YUKON_EXTRA=9\n", counters=True):
    folder = root / "logs" / run
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "uartlog").write_text(log)
    if counters:
        head = f"a\nb\nc\ndescription,{CYCLES},l1_htlb_miss\nt\nw\naw\n"
        lines = "".join(f"x,{(i + 1) * 10**8},{i * i * 10}\n" for i in range(rows))
        (folder / "AUTOCOUNTERFILE0.csv").write_text(head + lines)


def side_of(spark, runs, series="s", config="p.rt.rc.f"):
    start = dt.datetime(2024, 1, 1)
    timing = spark.createDataFrame(
        [(r, start, start + dt.timedelta(seconds=n)) for n, r in enumerate(runs, 1)], "run_id string, started_at timestamp_ntz, ended_at timestamp_ntz"
    )
    labels = spark.createDataFrame(
        [(r, series, "n", "ls", config, "/", "c", "a") for r in runs],
        "run_id string, series string, name string, command string, config string, dir string, config_id string, artifact_id string",
    )
    artifacts = spark.createDataFrame([("a", "hash")], "artifact_id string, md5 string")
    descriptions = spark.createDataFrame([("c", "text")], "config_id string, description string")
    return timing, labels, artifacts, descriptions


def tree(spark, out, name):
    from pyspark.errors import AnalysisException

    if name == "unlabelled":
        return spark.read.parquet(f"{out}/{name}").collect()
    try:
        return read_current(spark, f"{out}/{name}", LATEST_BY if name == "latest" else TREE).collect()
    except AnalysisException as e:
        assert "nothing is current" in str(e)
        return []


@pytest.mark.parametrize("whole_file_bytes", [10**6, 0])
def test_a_second_analysis_leaves_nothing_of_the_first(spark, tmp_path, whole_file_bytes):
    out, dirs = str(tmp_path / "out"), f"{tmp_path}/logs/*"
    one_run(tmp_path, "a", 9)
    analyse(spark, dirs, out, NAMES, *side_of(spark, ["a"]), whole_file_bytes)
    assert (len(tree(spark, out, "raw")), len(tree(spark, out, "deltas"))) == (6, 9)
    one_run(tmp_path, "a", 3)
    analyse(spark, dirs, out, NAMES, *side_of(spark, ["a"]), whole_file_bytes)
    assert [r.l1_htlb_miss for r in tree(spark, out, "results")] == [None]
    assert (len(tree(spark, out, "raw")), len(tree(spark, out, "deltas"))) == (0, 0)


def test_another_run_of_a_configuration_replaces_all_of_the_first(spark, tmp_path):
    out = str(tmp_path / "out")
    one_run(tmp_path / "1", "a", 9)
    analyse(spark, f"{tmp_path}/1/logs/*", out, NAMES, *side_of(spark, ["a"]))
    one_run(tmp_path / "2", "b", 2)
    analyse(spark, f"{tmp_path}/2/logs/*", out, NAMES, *side_of(spark, ["b"]))
    assert [r.run_id for r in tree(spark, out, "results")] == ["b"]
    assert [r.run_id for name in ("raw", "deltas") for r in tree(spark, out, name)] == []
    assert [r.run_id for r in tree(spark, out, "latest")] == ["b"]


@pytest.mark.parametrize("series", ["", None, "a/b=c %"])
def test_odd_labels_keep_their_samples(spark, tmp_path, series):
    out = str(tmp_path / "out")
    one_run(tmp_path, "a", 9)
    analyse(spark, f"{tmp_path}/logs/*", out, NAMES, *side_of(spark, ["a"], series=series))
    result = tree(spark, out, "results")[0]
    assert (result.series, result.l1_htlb_miss) == (series or None, 640.0)
    assert (len(tree(spark, out, "raw")), len(tree(spark, out, "deltas"))) == (6, 9)
    one_run(tmp_path, "a", 0)
    analyse(spark, f"{tmp_path}/logs/*", out, NAMES, *side_of(spark, ["a"], series=series))
    assert (len(tree(spark, out, "raw")), len(tree(spark, out, "deltas"))) == (0, 0)


def test_all_metrics_unlabelled_runs_summaries_and_missing_files(spark, tmp_path):
    out = str(tmp_path / "out")
    one_run(tmp_path, "a b%1+2", 8)
    one_run(tmp_path, "failed", 0, counters=False)
    one_run(tmp_path, "stranger", 7)
    os.symlink(tmp_path / "logs" / "a b%1+2", tmp_path / "logs" / "latest")
    analyse(spark, f"{tmp_path}/logs/*", out, NAMES, *side_of(spark, ["a b%1+2", "failed", "gone"]))
    metrics = {(r.run_id, r.metric): r.value for r in tree(spark, out, "metrics")}
    assert metrics["a b%1+2", "extra"] == 9.0 and metrics["a b%1+2", "l1_htlb_miss"] == 490.0
    assert {r.run_id: r.l1_htlb_miss for r in tree(spark, out, "results")} == {"a b%1+2": 490.0, "failed": None, "gone": None}
    assert {r.run_id for r in tree(spark, out, "unlabelled")} == {"stranger"}
    assert {r.run_id: r.text.startswith("Finished: n\n") for r in tree(spark, out, "summaries")} == dict.fromkeys(["a b%1+2", "failed", "gone"], True)
    assert [r.run_id for r in tree(spark, out, "latest")] == ["gone"]


def test_directories_of_one_name_are_refused(spark, tmp_path):
    one_run(tmp_path / "u1", "run1", 7)
    one_run(tmp_path / "u2", "run1", 7)
    with pytest.raises(ValueError, match="run1"):
        analyse(spark, f"{tmp_path}/*/logs/*", str(tmp_path / "out"), NAMES, *side_of(spark, ["run1"]))


def test_nothing_of_a_job_stays_in_the_shared_folder(spark, tmp_path):
    from runscope.session import shared_folder

    one_run(tmp_path, "a", 9)
    side = side_of(spark, ["a"])
    before = set(os.listdir(shared_folder(spark)))
    analyse(spark, f"{tmp_path}/logs/*", str(tmp_path / "out"), NAMES, *side, 0)
    assert set(os.listdir(shared_folder(spark))) == before
