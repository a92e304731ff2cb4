"""Text files written, listed and read by the executors."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from runscope.sinks.files import write_run_files
from runscope.sources import counters, logs, texts


@settings(max_examples=300, deadline=None)
@given(st.text("ab\n\r\x0b\x85é", max_size=40).map(str.encode), st.integers(1, 9), st.integers(1, 5))
def test_blocks_give_each_line_once(data, block, tail):
    texts_tail, texts.TAIL_BYTES = texts.TAIL_BYTES, tail
    try:
        read_at = lambda n, at: data[at : at + n]
        got = [line for b in range(0, len(data), block) for line in texts.block_lines(read_at, b, min(b + block, len(data)), len(data))]
    finally:
        texts.TAIL_BYTES = texts_tail
    assert got == data.splitlines()


def test_lines_and_texts_equal_those_of_sparks_reader(spark, tmp_path):
    made = {"a": b"\xef\xbb\xbfx\r\ny\r\rz", "b é%1+2": b"\n\n", "c": b"\xff\xfe bad \n" * 50, "_hidden": b"no\n", ".h": b"no\n", "empty": b""}
    for name, data in made.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        listed = texts.listed_texts(spark, str(tmp_path / "in"))
        lines = [tuple(r) for r in texts.text_lines(listed).select(F.hex("value")).collect()]
        theirs = [tuple(r) for r in spark.read.text(str(tmp_path / "in")).select(F.hex("value")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(lines) == sorted(theirs) and len(lines) == 4 + 2 + 50
    whole = [r[0] for r in texts.whole_texts(listed).select(F.hex("value")).collect()]
    assert sorted(whole) == sorted(r[0] for r in spark.read.text(str(tmp_path / "in"), wholetext=True).select(F.hex("value")).collect())


def test_what_only_spark_reads_is_left_to_it(spark, tmp_path):
    (tmp_path / "packed").mkdir()
    (tmp_path / "packed" / "x.gz").write_bytes(b"")
    (tmp_path / "packed" / "y.gz").write_bytes(b"1")
    (tmp_path / "parts" / "k=1").mkdir(parents=True)
    (tmp_path / "parts" / "k=1" / "f").write_bytes(b"1")
    for path in ("packed", "parts", "nothing", "nothing/*"):
        assert texts.listed_texts(spark, str(tmp_path / path)) is None
    assert texts.listed_texts(spark, str(tmp_path / "parts" / "*")).count() == 1
    assert texts.listed_texts(spark, str(tmp_path / "parts" / "*"), name="g*") is None


@pytest.mark.parametrize("by_executors", [True, False])
def test_run_files_equal_those_of_sparks_writer(spark, tmp_path, monkeypatch, by_executors):
    monkeypatch.setattr("runscope.sinks.files.reachable", lambda url: by_executors)
    rows = [(1, "a"), (2, "b\nc"), (1, "é"), (None, "n"), (3, None), (4, "")]
    write_run_files(spark.createDataFrame(rows, "run_id bigint, value string").coalesce(1), str(tmp_path / "out"))
    if by_executors:  # in the rows' order, which Spark's writer doesn't promise
        assert [p.read_bytes() for p in (tmp_path / "out" / "run_id=1").iterdir()] == ["a\né\n".encode()]
    got = {(p.parent.name, b"\n".join(sorted(p.read_bytes().split(b"\n")[:-1])) + b"\n") for p in (tmp_path / "out").glob("*/part-*.txt")}
    assert got == {("run_id=1", "a\né\n".encode()), ("run_id=2", b"b\nc\n"), ("run_id=__HIVE_DEFAULT_PARTITION__", b"n\n"), ("run_id=3", b"\n"), ("run_id=4", b"\n")}
    assert by_executors is False or all(f.name.startswith("part-") for f in (tmp_path / "out").glob("*/*"))


def test_many_files_are_read_in_several_tasks_and_not_listed_by_the_driver(spark, tmp_path, monkeypatch):
    def driver(*args, **kwargs):
        raise AssertionError("Spark's reader lists on the driver")

    for module in (logs, counters):
        monkeypatch.setattr(module, "text_of", driver)
    runs = spark.range(600).select(F.col("id").alias("run_id"), F.concat(F.lit("boot YUKON_N="), "id").alias("value"))
    write_run_files(runs, str(tmp_path / "logs"))
    found = logs.read_log_tokens(spark, f"{tmp_path}/logs/*/*.txt")
    assert found.count() == 600 and found.select(F.spark_partition_id()).distinct().count() > 1
    parsed = counters.read_counter_samples(spark, f"{tmp_path}/logs/*/*.txt", header_line=0, data_line=0)
    assert parsed.select("run_id").distinct().count() == 600
