"""All metrics in a wide row, cells without a value, and gaps of a sweep."""

import json

import pytest
from pyspark.sql import functions as F

from runscope import fixtures as fx
from runscope.formats import CYCLES
from runscope.operators.metrics import every_metric, metric_at, results_pivot
from runscope.operators.runs import coverage, coverage_gaps
from runscope.plans.postrun import analyse
from runscope.sinks.results import read_tree, write_results
from runscope.sources import counters
from tests.test_postrun import one_run, side_of

ODD = 'b "x" it\'s [0].y \\'


def test_runs_with_different_metrics_share_a_table(spark, tmp_path):
    rows = [(1, "a", 1.0), (1, ODD, 2.0), (1, CYCLES, 3.5), (1, "it's", 4.0), (2, "c", None), (2, None, 4.0), (3, None, 1.0), (2, "", 5.0)]
    path = str(tmp_path / "wide")
    results_pivot(spark.createDataFrame(rows, "run_id long, name string, value double"), ["a"], every=True).write.parquet(path)
    wide = spark.read.parquet(path)
    for name in ("a", ODD, CYCLES, "it's", "c", "", "nowhere"):
        got = {r[0]: r[1] for r in wide.select("run_id", metric_at(name)).collect()}
        assert got == {run: next((v for r, n, v in rows if (r, n) == (run, name)), None) for run in (1, 2, 3)}
    assert sorted(map(tuple, every_metric(wide).collect()), key=str) == sorted((r for r in rows if r[1] is not None), key=str)


def test_an_analysis_keeps_metrics_that_nobody_named(spark, tmp_path):
    out = str(tmp_path / "out")
    one_run(tmp_path, "a", 9)
    analyse(spark, f"{tmp_path}/logs/*", out, [], *side_of(spark, ["a"]))
    results = read_tree(spark, f"{out}/results")
    assert results.select(metric_at("extra"), metric_at("l1_htlb_miss"), metric_at(CYCLES)).first()[:] == (9.0, 640.0, 9e8)
    write_results(results, str(tmp_path / "csv"), "csv")
    text = read_tree(spark, str(tmp_path / "csv"), fmt="csv").first()["every_metric"]
    assert json.loads(text)["extra"] == 9.0


@pytest.mark.parametrize("whole_file_bytes", [10**6, 0])
def test_cells_without_a_value_are_told_once_with_their_reason(spark, tmp_path, whole_file_bytes):
    for run, lines in (("r1", ["x,1,2", "x,,3", 'x,"4\n",n/a', "x,5", "x,6,1e400", "x,7,8.9"]), ("r2", ["x,1,2", "x, \t,0x1"])):
        (tmp_path / run).mkdir()
        head = f"a\nb\nc\ndescription,{CYCLES},k\nt\nw\naw\n"
        (tmp_path / run / "c.csv").write_text(head + "\n".join(lines) + "\n")
    parsed = counters.read_counter_samples(spark, f"{tmp_path}/*/c.csv", whole_file_bytes, reasons=True)
    samples, rejects, counts = counters.split_rejects(parsed)
    got = {(r.run_id, r.sample_idx, r.counter): (r.reason, r.cell) for r in rejects.collect()}
    assert got == {
        ("r1", 1, CYCLES): ("empty", ""), ("r1", 2, CYCLES): ("number", "4\n"), ("r1", 2, "k"): ("number", "n/a"),
        ("r1", 3, CYCLES): ("cells", None), ("r1", 3, "k"): ("cells", None), ("r1", 4, "k"): ("number", "1e400"),
        ("r2", 1, CYCLES): ("empty", " \t"), ("r2", 1, "k"): ("number", "0x1"),
    }
    assert counts == {"all": 16, "cells": 2, "empty": 2, "number": 4}
    assert samples.columns == ["run_id", "sample_idx", "cycles", "counter", "value"] and samples.where("value is null").count() == 8


def test_counts_of_rejects_equal_the_twin(spark):
    files = fx.counter_files(spark, "/root/testdata/sf0.001")
    _, rejects, counts = counters.split_rejects(counters.counter_scan(files, reasons=True))
    sizes = fx.table(spark, "/root/testdata/sf0.001", "documents").select(F.explode(F.split("text", r"\.")).alias("s")).select(F.length("s").alias("n"))
    assert counts == {"all": 6 * sizes.count(), "cells": 0, "empty": 0, "number": sizes.where("n % 97 = 0").count()}
    assert rejects.count() == counts["number"] > 0
    # both tables come from what was written, not from another parse
    assert "regexp" not in rejects._jdf.queryExecution().executedPlan().toString().lower()


def test_coverage_and_its_gaps(spark):
    grid = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), (None, 1), ("a", 1)], "program string, cores int")
    runs = spark.createDataFrame([("a", 1)] * 50 + [("b", 2), (None, 1), ("z", 9), ("a", None)], "program string, cores int")
    covered = coverage(grid, runs, ("program", "cores"))
    assert {tuple(r) for r in covered.collect()} == {("a", 1, 50), ("a", 2, 0), ("b", 1, 0), ("b", 2, 1), (None, 1, 1)}
    gaps = {(r.axis, r.value): (r.expected, r.missing, r.runs) for r in coverage_gaps(covered, ("program", "cores")).collect()}
    assert gaps == {
        ("program", "a"): (2, 1, 50), ("program", "b"): (2, 1, 1), ("program", None): (1, 0, 1),
        ("cores", "1"): (3, 1, 51), ("cores", "2"): (2, 1, 1), (None, None): (5, 2, 52),
    }
    assert coverage(grid, runs.where("false"), ("program", "cores")).agg(F.sum("runs")).first()[0] == 0
    assert [tuple(r) for r in coverage_gaps(covered.where("false"), ("program", "cores")).collect()] == []
