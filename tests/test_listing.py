"""Listings by the executors, with empty files."""

import hashlib
import os
from urllib.parse import unquote

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from runscope.sources import listing
from runscope.sources.files import artifact_md5, read_artifact_hashes, read_artifacts, read_run_files, run_catalog
from runscope.sources.logs import read_descriptions

EMPTY = "d41d8cd98f00b204e9800998ecf8427e"


@pytest.fixture
def files(tmp_path):
    """Run directories, some with odd names, one with only empty files, one without any file."""
    made = {}
    for run in ("a2024-01-01120000", "b b%1+2é2024-01-02-130000", "only-empty2024-01-03140000", "[x]{y},z"):
        for name, data in (("uartlog", b"x" * len(run)), ("none.bin", b""), ("deep/er/lib.so", b"abc")):
            if data and run.startswith("only"):
                continue
            path = tmp_path / "logs" / run / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(data)
            made[str(path)] = data
    (tmp_path / "logs" / "nothing").mkdir()
    return tmp_path, made


def place(url):
    return unquote(url.replace("+", "%2B")).removeprefix("file://")


@pytest.mark.parametrize("by_executors", [True, False])
def test_listing_equals_a_walk(spark, files, monkeypatch, by_executors):
    root, made = files
    monkeypatch.setattr(listing, "reachable", lambda url: by_executors)
    got = listing.list_files(spark, f"{root}/logs", recursive=True).collect()
    assert {place(r.path) if by_executors else unquote(r.path).removeprefix("file:").replace("///", "/") for r in got} == set(made)
    assert sorted(r.length for r in got) == sorted(map(len, made.values()))
    mtimes = {int(os.stat(p).st_mtime) for p in made}
    assert {int(r.modificationTime.timestamp()) for r in got} <= mtimes


def test_globs_match_level_by_level(spark, files):
    root, made = files
    listed = lambda *globs: {place(r.path) for r in listing.list_files(spark, [f"{root}/{g}" for g in globs]).collect()}
    assert listed("logs/*/uartlog") == {p for p in made if p.endswith("/uartlog")}
    assert listed("logs/{a,b}*/*.bin") == {p for p in made if p.endswith(".bin") and p.split("/")[-2][0] in "ab"}
    assert listed("logs/[!ab]*/none.bin", "logs/*/none.bin") == {p for p in made if p.endswith("none.bin")}  # each once
    assert listed("logs/\\[x\\]*/uartlog") == {p for p in made if p.endswith("z/uartlog")}
    assert listed("logs/a2024-01-01120000/uartlog") == {f"{root}/logs/a2024-01-01120000/uartlog"}
    assert listed("logs/*/*/er/l?b.so") == {p for p in made if p.endswith("lib.so")}
    assert listed("none/*", "logs/nothing/*") == set()


@settings(max_examples=200, deadline=None)
@given(st.text("ab*?[]!{},.\\", max_size=8), st.text("ab.[],", max_size=5))
def test_any_glob_makes_a_pattern(part, name):
    import re

    pattern = listing.glob_pattern(part)
    if part.count("{") == part.count("}") == part.count("[") == 0 and "\\" not in part:
        import fnmatch

        assert bool(re.fullmatch(pattern, name)) == fnmatch.fnmatchcase(name, part.replace("]", "[]]"))


def test_the_driver_holds_no_list(spark, files, monkeypatch):
    root, _ = files
    monkeypatch.setattr(listing, "_listed_by_driver", lambda *_: pytest.fail("listed by the driver"))
    assert run_catalog(read_run_files(spark, f"{root}/logs")).count() == 7


def test_a_run_of_empty_files_is_in_the_catalogue(spark, files):
    root, made = files
    got = {r.path: (r.run_name, r.length) for r in run_catalog(read_run_files(spark, f"{root}/logs")).collect()}
    assert got[f"file:{root}/logs/only-empty2024-01-03140000/none.bin"] == ("only-empty", 0)
    assert got[f"file:{root}/logs/b b%1+2é2024-01-02-130000/uartlog"][0] == "b b%1+2é"


def test_artifacts_of_any_size_have_a_hash(spark, files):
    root, made = files
    want = {f"file:{p}": hashlib.md5(d).hexdigest() for p, d in made.items() if "deep" not in p}
    globs = f"{root}/logs/*"
    by_value = {r.artifact_id: r.md5 for r in artifact_md5(read_artifacts(spark, globs)).collect()}
    assert by_value == want and EMPTY in by_value.values()
    assert {r.artifact_id: r.md5 for r in read_artifact_hashes(spark, globs).collect()} == want
    # too large for a value: hashed by the piecewise reader all the same
    some = {r.artifact_id: r.md5 for r in artifact_md5(read_artifacts(spark, globs, value_bytes=20)).collect()}
    assert None in some.values() and all(some[k] in (None, v) for k, v in want.items())


def test_empty_and_missing_descriptions(spark, tmp_path):
    for name, text in (("a", "first"), ("b", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "description.txt").write_text(text)
    read = lambda glob: {r.config_id: r.value for r in read_descriptions(spark, f"{tmp_path}/{glob}/description.txt").collect()}
    assert (read("*"), read("b"), read("c*")) == ({"a": "first", "b": ""}, {"b": ""}, {})


def test_many_directories(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f").write_text("x" * (i % 3))
    got = listing.list_files(spark, f"{tmp_path}/*/f")
    assert got.agg(F.count("*"), F.sum("length")).first()[:] == (400, sum(i % 3 for i in range(400)))


def test_tasks_by_number_and_bytes_of_the_work(spark, monkeypatch):
    def tasks(n, length):
        return listing.dealt(spark.range(n).select(F.col("id").alias("path"), F.lit(length).alias("length")), ["path"]).rdd.getNumPartitions()

    cores = spark.sparkContext.defaultParallelism
    assert tasks(1, 1) == 1
    assert tasks(5000, 1) == max(3, min(cores, 40))
    assert tasks(40 * listing.TASK_ROWS, 1) == max(40, cores)  # 320 tasks before, of which most time was their start
    assert tasks(90, listing.TASK_BYTES) == max(90, 1)
