"""Stored samples are analysed again without a shuffle."""

from pyspark.sql import functions as F

from runscope import fixtures as fx
from runscope.operators import metrics, series
from runscope.sinks.clustered import open_clustered, with_previous_stored, write_clustered

SF_DIR = "/root/testdata/sf0.001"


def test_the_second_read_has_no_exchange(spark, tmp_path):
    write_clustered(fx.counter_samples(spark, SF_DIR), str(tmp_path / "t"), 6)
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 6  # a file per bucket
    stored = open_clustered(spark, str(tmp_path / "t"), 6, "bigint")
    runs = spark.createDataFrame([(1, 2000.0)], "run_id long, instructions double")
    late = series.warmup_drop(with_previous_stored(stored))
    frames = {
        "final": metrics.counter_final(series.warmup_drop(stored)),
        "deltas": series.counter_delta(late),
        "ratios": series.mpki_series(series.warmup_drop(stored), runs, broadcast_bytes=1 << 20),
        "table": series.delta_table(late, runs, broadcast_bytes=1 << 20),
    }
    for name, frame in frames.items():
        frame.collect()  # the plan that ran
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan, name


def test_predecessors_of_stored_samples(spark, tmp_path):
    rows = [(f"r{r}", i * 2, i, f"c{c}", None if (i * 7 + c + r) % 3 else i) for r in range(3) for c in range(2) for i in range(40)]
    samples = spark.createDataFrame(rows, "run_id string, sample_idx long, cycles long, counter string, value long")
    stored = write_clustered(samples.orderBy(F.rand(1)), str(tmp_path / "t"), 3)
    known = {}
    want = []
    for run, idx, cycles, counter, value in rows:
        want.append((run, idx, cycles, counter, value, *known.get((run, counter), (None, None))))
        if value is not None:
            known[run, counter] = value, idx
    assert sorted(map(str, map(tuple, with_previous_stored(stored).collect()))) == sorted(map(str, want))
    assert with_previous_stored(write_clustered(samples.where("false"), str(tmp_path / "e"), 3)).collect() == []
