"""Newly finished runs are picked up once."""

from runscope.formats import CYCLES
from runscope.streaming.finished import collect_log_metrics, collect_samples


def add_run(root, name, log, rows):
    folder = root / "incoming" / name
    folder.mkdir(parents=True)
    (folder / "uartlog").write_text(log)
    head = f"a\nb\nc\ndescription,{CYCLES}\nt\nw\naw\n"
    (folder / "AUTOCOUNTERFILE0.csv").write_text(head + "".join(f"x,{i}\n" for i in range(rows)))
    target = root / "runs" / name
    target.parent.mkdir(exist_ok=True)
    folder.rename(target)


def test_new_runs_only(spark, tmp_path):
    dirs, out, state = str(tmp_path / "runs" / "*"), str(tmp_path / "out"), str(tmp_path / "state")

    def drain():
        collect_log_metrics(spark, dirs, f"{out}/metrics", f"{state}/metrics")
        collect_samples(spark, dirs, f"{out}/samples", f"{state}/samples")
        metrics = spark.read.parquet(f"{out}/metrics").collect()
        samples = spark.read.parquet(f"{out}/samples").collect()
        return (
            sorted((r.run_id, r.name, r.value) for r in metrics),
            sorted((r.run_id, r.sample_idx, r.value) for r in samples),
        )

    add_run(tmp_path, "r1", "YUKON_A=1\n" + "noise\n" * 500 + "YUKON_A=2 YUKON_B_C=3\n", 8)
    add_run(tmp_path, "r2", "nothing\n", 3)
    first = drain()
    assert first == ([("r1", "a", 2.0), ("r1", "b", 3.0)], [("r1", 0, 6), ("r1", 1, 7)])
    assert drain() == first
    add_run(tmp_path, "r3", "YUKON_A=9\n", 7)
    assert drain() == (first[0] + [("r3", "a", 9.0)], first[1] + [("r3", 0, 6)])


def test_another_checkpoint_writes_beside(spark, tmp_path):
    dirs, out = str(tmp_path / "runs" / "*"), str(tmp_path / "out")
    add_run(tmp_path, "r1", "YUKON_A=1\n", 8)
    collect_log_metrics(spark, dirs, out, str(tmp_path / "state1"))
    (tmp_path / "runs" / "r1").rename(tmp_path / "r1-away")
    add_run(tmp_path, "r2", "YUKON_A=2\n", 8)
    collect_log_metrics(spark, dirs, out, str(tmp_path / "state2"))
    assert sorted(r.run_id for r in spark.read.parquet(out).collect()) == ["r1", "r2"]
