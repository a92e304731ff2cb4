"""Trees change as a whole or not at all."""

import datetime as dt
import inspect
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from runscope.operators.runs import latest_pointer
from runscope.plans.postrun import LATEST_BY, analyse
from runscope.sinks import results, snapshots
from runscope.sinks.snapshots import compact, current, drop_unused, merge_rows, read_current, replace_places
from tests.test_postrun import NAMES, one_run, side_of

BY = ("series", "name")
SCHEMA = "run_id long, series string, name string, v double"


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(spark, root):
    return sorted((tuple(r) for r in read_current(spark, root, BY, frame(spark)).collect()), key=str)


def test_places_are_replaced_added_and_emptied_in_one_commit(spark, tmp_path):
    root = str(tmp_path / "t")
    replace_places(frame(spark, (1, "a", "x", 1.0), (2, "a", "x", 2.0), (3, "b", None, 3.0), (4, "007", "y/=% ", 4.0)), root, BY)
    replace_places(frame(spark, (5, "a", "x", 5.0), (6, "c", "", 6.0)), root, BY, frame(spark, (0, "b", None, 0.0), (0, "q", "q", 0.0)))
    assert rows_of(spark, root) == [(4, "007", "y/=% ", 4.0), (5, "a", "x", 5.0), (6, "c", None, 6.0)]
    replace_places(frame(spark), root, BY, frame(spark, (0, "c", None, 0.0)))
    assert rows_of(spark, root) == [(4, "007", "y/=% ", 4.0), (5, "a", "x", 5.0)]


def test_a_job_lost_before_its_commit_leaves_the_old_rows_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    replace_places(frame(spark, (1, "a", "x", 1.0), (2, "b", "x", 2.0)), root, BY)
    before = rows_of(spark, root)

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_claim", lost)
        with pytest.raises(KeyboardInterrupt):
            replace_places(frame(spark, (7, "a", "x", 7.0)), root, BY, frame(spark, (0, "b", "x", 0.0)))
    assert len(list((tmp_path / "t").glob("version=*"))) == 2  # all of its files are there
    assert rows_of(spark, root) == before
    assert drop_unused(spark, root) == 0 and drop_unused(spark, root, older_than_s=0) == 1
    replace_places(frame(spark, (7, "a", "x", 7.0)), root, BY)
    assert rows_of(spark, root) == [(2, "b", "x", 2.0), (7, "a", "x", 7.0)]


KILLED = """
import os, sys
sys.path.insert(0, {repo!r})
from runscope.session import local_session
from runscope.sinks import snapshots
spark = local_session(2, "killed", **{{"spark.checkpoint.dir": {folder!r}}})
snapshots._claim = lambda *_: os._exit(9)
df = spark.createDataFrame([(7, "a", "x", 7.0)], {schema!r})
snapshots.replace_places(df, {root!r}, ("series", "name"))
"""


def test_a_process_killed_between_write_and_commit(spark, tmp_path):
    root = str(tmp_path / "t")
    replace_places(frame(spark, (1, "a", "x", 1.0)), root, BY)
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = KILLED.format(repo=repo, folder=str(tmp_path / "c"), schema=SCHEMA, root=root)
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=300).returncode == 9
    assert len(list((tmp_path / "t").glob("version=*/series=a/name=x/*.parquet"))) == 2
    assert rows_of(spark, root) == [(1, "a", "x", 1.0)]


def test_two_writers_with_the_same_number_both_count(spark, tmp_path, monkeypatch):
    root, claim, rival = str(tmp_path / "t"), snapshots._claim, []
    replace_places(frame(spark, (1, "a", "x", 1.0)), root, BY)

    def late(*args):
        if not rival:  # another writer commits first
            rival.append(1)
            replace_places(frame(spark, (2, "b", "x", 2.0)), root, BY)
        claim(*args)

    monkeypatch.setattr(snapshots, "_claim", late)
    replace_places(frame(spark, (3, "a", "x", 3.0)), root, BY)
    assert rows_of(spark, root) == [(2, "b", "x", 2.0), (3, "a", "x", 3.0)]
    assert current(spark, root, BY)[0] == 3
    rival.clear()
    merge_rows(frame(spark, (4, "b", "x", 4.0)), root, BY, lambda rows: rows.groupBy("series", "name").agg(F.max("run_id").alias("run_id"), F.sum("v").alias("v")))
    # the rival wrote b anew, and the merge saw that
    assert rows_of(spark, root) == [(3, "a", "x", 3.0), (4, "b", "x", 6.0)]


def test_versions_that_nothing_names_go_and_many_become_one(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    for k in range(4):
        replace_places(frame(spark, (k, "a", "x", 1.0)), root, BY)
    assert len(list((tmp_path / "t").glob("version=*"))) == 2  # a reader of the manifest before may still be at work
    monkeypatch.setattr(snapshots, "MAX_VERSIONS", 2)
    for k in range(3):
        replace_places(frame(spark, (k, f"s{k}", "x", 1.0)), root, BY)
    versions = current(spark, root, BY)[1].select("version").distinct()
    assert len(rows_of(spark, root)) == 4 and versions.count() <= 2
    compact(spark, root, BY, frame(spark))
    assert current(spark, root, BY)[1].select("version").distinct().count() == 1 and len(rows_of(spark, root)) == 4


def test_no_place_is_deleted_by_a_loop_of_the_driver():
    assert "toLocalIterator" not in inspect.getsource(results) + inspect.getsource(snapshots)


def test_an_analysis_of_older_runs_does_not_move_a_pointer_back(spark, tmp_path):
    out = str(tmp_path / "out")

    def ended(run, day, folder):
        one_run(tmp_path / folder, run, 8)
        timing, *side = side_of(spark, [run])
        start = dt.datetime(2024, 1, day)
        timing = spark.createDataFrame([(run, start, start)], timing.schema)
        analyse(spark, f"{tmp_path}/{folder}/logs/*", out, NAMES, timing, *side)
        return [(r.run_id, r.ended_at.day) for r in read_current(spark, f"{out}/latest", LATEST_BY).collect()]

    assert ended("new", 9, "1") == [("new", 9)]
    assert ended("old", 3, "2") == [("new", 9)]
    assert ended("newer", 10, "3") == [("newer", 10)]


def test_the_merge_of_pointers_keeps_one_row_per_key(spark, tmp_path):
    root = str(tmp_path / "latest")
    schema = "series string, name string, run_id string, at long"
    keep = lambda rows: latest_pointer(rows, BY, "at")
    for batch in ([("s", "n", "a", 5), ("s", "n", "b", 5), ("t", "n", "c", 1)], [("s", "n", "z", 4), (None, "n", "d", 2)], [("t", "n", "e", None)]):
        merge_rows(spark.createDataFrame(batch, schema), root, BY, keep)
    got = {(r.series, r.name, r.run_id, r.at) for r in read_current(spark, root, BY).collect()}
    assert got == {("s", "n", "b", 5), ("t", "n", "c", 1), (None, "n", "d", 2)}


def test_no_row_is_read_to_know_or_check_the_places_written(spark, tmp_path):
    root = str(tmp_path / "t")
    replace_places(frame(spark, (1, "a", "x", 1.0), (2, "007", None, 2.0)), root, BY)
    for file in (tmp_path / "t").glob("version=*/**/*.parquet"):
        file.write_bytes(b"no rows")
    places = snapshots._listed_places(spark, root, [r.version for r in current(spark, root, BY)[1].select("version").distinct().collect()], BY)
    assert sorted(tuple(r)[:2] for r in places.collect()) == [("007", ""), ("a", "x")]
    plan = read_current(spark, root, BY, frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FileScan" in plan
    replace_places(frame(spark, (3, "a", "x", 3.0)), root, BY)
    assert "Join" in read_current(spark, root, BY, frame(spark))._jdf.queryExecution().executedPlan().toString()
