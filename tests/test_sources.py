"""Parsers on odd texts, and readers on real files in a temporary directory."""

import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from runscope.formats import CYCLES
from runscope.functions.labels import metric_name
from runscope.operators.metrics import uart_last_wins
from runscope.sources.counters import _cells, counter_scan, counter_scan_lines, read_counter_samples
from runscope.sources.files import artifact_md5, read_artifacts, read_run_files, run_catalog
from runscope.sources.logs import (
    description_scan,
    read_descriptions,
    read_log_tokens,
    submission_parse,
    uart_scan,
)

HEAD = "a\nb\nc\n{header}\nt\nw\naw\n"


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "run_id bigint, value string")


def tokens(spark, text, **options):
    rows = uart_scan(texts(spark, text), **options).orderBy("pos").collect()
    return [(r.pos, r.name, r.value) for r in rows]


def samples(spark, text, **options):
    rows = counter_scan(texts(spark, text), **options).collect()
    return {(r.counter, r.sample_idx): r.value for r in rows}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", []),
        ("YUKON_=5 YUKON_A= yukon_a=1 YUKON_A=x", []),
        ("aYUKON_A=1bYUKON_B=2", [(0, "a", 1.0), (1, "b", 2.0)]),
        ("YUKON_A=1\r\nYUKON_A=2\rYUKON_A=3", [(0, "a", 1.0), (1, "a", 2.0), (2, "a", 3.0)]),
        ("YUKON_L1_HTLB_MISS=5", [(0, "l1", 5.0)]),
        ("YUKON__X=5", [(0, "", 5.0)]),
        ("YUKON_É²中=7", [(0, "é²中", 7.0)]),
        ("YUKON_A=٣४", [(0, "a", 34.0)]),
        ("YUKON_A=12.5e3", [(0, "a", 12.0)]),
        ("YUKON_A=1YUKON_B=2", [(0, "a", 1.0), (1, "b", 2.0)]),
    ],
)
def test_log_tokens(spark, text, expected):
    assert tokens(spark, text) == expected


def test_full_metric_names(spark):
    assert tokens(spark, "YUKON_L1_HTLB_MISS=5", name_mode="full") == [(0, "l1_htlb_miss", 5.0)]
    with pytest.raises(ValueError):
        metric_name(F.lit("x"), "other")


def test_last_token_wins_over_lines_and_within_a_line(spark):
    lines = spark.createDataFrame(
        [(1, 9, "YUKON_A=1 YUKON_A=2"), (1, 3, "YUKON_A=7 YUKON_B_X=4"), (1, 5, "YUKON_B_Y=6")],
        "run_id bigint, line_no bigint, value string",
    ).repartition(3)
    got = uart_last_wins(uart_scan(lines, order=("line_no",))).collect()
    assert {(r.run_id, r.name): r.value for r in got} == {(1, "a"): 2.0, (1, "b"): 6.0}


def test_counter_file_with_warm_up(spark):
    text = HEAD.format(header='description,"Clock cycles, local",l1_htlb_miss') + "".join(
        f"x,{i},{i * 10}\n" for i in range(8)
    )
    got = samples(spark, text)
    assert got[("Clock cycles, local", 7)] == 7 and got[("l1_htlb_miss", 7)] == 70
    assert len(got) == 16 and {c for c, _ in got} == {"Clock cycles, local", "l1_htlb_miss"}


def test_counter_cells(spark):
    header = f"description,{CYCLES},x,x,,x"
    text = HEAD.format(header=header) + (
        "d,1, 7 ,1.9,+4,-3\r\n"
        "\r"
        "   \n"
        '"d, e",2,"8","",nan,inf\n'
        "d,3,9\n"
        "d,4,1,2,3,4,5\n"
        "d,5,1e3,1d,0x10,99999999999999999999\n"
        "d,6,9223372036854775807,-.5,5.,"
    )
    got = samples(spark, text)
    names = [CYCLES, "x", "x.1", "Unnamed: 4", "x.2"]
    assert [got[(n, 0)] for n in names] == [1, 7, 1, 4, -3]
    assert [got[(n, 1)] for n in names] == [2, 8, None, None, None]
    assert [got[(n, 2)] for n in names] == [None] * 5
    assert [got[(n, 3)] for n in names] == [None] * 5
    assert [got[(n, 4)] for n in names] == [5, 1000, None, None, None]
    assert [got[(n, 5)] for n in names] == [6, 2**63 - 1, 0, 5, None]
    assert len(got) == 30


@pytest.mark.parametrize(
    "line, cells",
    [
        ('"a"', ["a"]),
        (',"",b,', ["", "", "b", ""]),
        ('"a,b","c ""d"", e",f', ["a,b", 'c "d", e', "f"]),
        ('x"y,z"w,"', ['x"y', 'z"w', '"']),  # a quote within a cell is a character
        ('"' + "a," * 50_000 + '",b', ["a," * 50_000, "b"]),
        ('""' + "," * 20_000, [""] * 20_001),
    ],
)
def test_quoted_cells(spark, line, cells):
    frame = spark.createDataFrame([(line,)], "line string")
    assert frame.select(_cells(F.col("line"))).first()[0] == cells


def test_long_runs_of_white_space(spark):
    text = " a" + " \n" * 100_000 + "b" + " " * 100_000
    files = spark.createDataFrame([("c", text), ("d", " " * 100_000)], "config_id string, value string")
    got = {r.config_id: r.description for r in description_scan(files).collect()}
    assert got == {"c": text.strip(), "d": ""}


def test_strict_counter_cells_raise(spark):
    text = HEAD.format(header=f"description,{CYCLES}") + "d,1\nd,n/a\n"
    assert samples(spark, text)[(CYCLES, 1)] is None
    with pytest.raises(PySparkException, match="bad counter cell in run 0, sample 1"):
        samples(spark, text, strict=True)


def test_short_counter_files_give_no_samples(spark):
    assert samples(spark, "") == {} and samples(spark, "a\nb\nc\nh,g") == {}
    assert samples(spark, HEAD.format(header="description,x")) == {}


@pytest.fixture
def counter_tree(tmp_path):
    """Runs whose files differ in size, with blank lines and a preamble that holds some."""
    for run, rows in (("small-1", 3), ("big-1", 4000), ("big-2", 2500), ("empty-1", 0)):
        folder = tmp_path / run
        folder.mkdir()
        lines = ["a", "", "c", f'description,{CYCLES},"m, all"', "t", "w", " "]
        for i in range(rows):
            lines.append(f"x,{i * 100},{i * 7}" if i % 13 else f'"q, x",{i * 100}, {i * 7}.5 ')
            if i % 50 == 0:
                lines.append("" if i % 100 else "  \t")
        (folder / "AUTOCOUNTERFILE0.csv").write_text("\n".join(lines) + "\n\n")
    return str(tmp_path / "*" / "AUTOCOUNTERFILE0.csv")


def as_rows(df):
    return sorted(tuple(r) for r in df.select("run_id", "sample_idx", "cycles", "counter", "value").collect())


def test_split_files_equal_whole_files(spark, counter_tree):
    whole = as_rows(read_counter_samples(spark, counter_tree))
    assert len(whole) == 2 * (3 + 4000 + 2500)
    assert ("big-1", 3999, 399900, "m, all", 27993) in whole
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(counter_tree).rdd.getNumPartitions() > 20
        assert as_rows(read_counter_samples(spark, counter_tree, whole_file_bytes=1000)) == whole
        assert as_rows(read_counter_samples(spark, counter_tree, whole_file_bytes=0)) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_only_the_first_lines_are_shuffled_for_the_header(spark):
    lines = spark.createDataFrame([], "path string, block bigint, seq bigint, value string")
    plan = counter_scan_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit [path" in plan and "row_number(), 7, Partial" in plan


def test_file_size_prunes_the_listing(spark, counter_tree):
    size = F.col("_metadata.file_size")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for whole, wanted, files in ((True, size <= 1000, 2), (False, size > 1000, 2)):
            plan = spark.read.text(counter_tree, wholetext=whole).where(wanted)._jdf.queryExecution().executedPlan()
            plan.executeCollect()
            assert plan.collectLeaves().head().metrics().apply("numFiles").value() == files
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_last_log_token_across_splits(spark, tmp_path):
    for run in ("run-a", "run-b"):
        folder = tmp_path / run
        folder.mkdir()
        lines = [f"noise {i} YUKON_N={i} YUKON_M_{i}={i} tail" for i in range(3000)]
        lines += ["plain noise"] * 2000 + ([] if run == "run-a" else ["YUKON_N=1"])
        (folder / "uartlog").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = read_log_tokens(spark, str(tmp_path / "*" / "uartlog"))
        assert found.count() == 12001
        got = {(r.run_id, r.name): r.value for r in uart_last_wins(found).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {
        ("run-a", "n"): 2999.0, ("run-a", "m"): 2999.0, ("run-b", "n"): 1.0, ("run-b", "m"): 2999.0,
    }


def test_descriptions(spark, tmp_path):
    for config, text in (("c1", "  two words \x1f \n\n"), ("c2", ""), ("c3", " \n")):
        (tmp_path / config).mkdir()
        (tmp_path / config / "description.txt").write_text(text)
    configs = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("c4",)], "config_id string")
    read = read_descriptions(spark, str(tmp_path / "*" / "description.txt"))
    got = {r.config_id: r.description for r in description_scan(read, configs).collect()}
    assert got == {"c1": "two words", "c2": "", "c3": "", "c4": "Unk."}


def test_artifact_hashes(spark, tmp_path):
    content = bytes(range(256)) * 1000
    (tmp_path / "lib.so.1").write_bytes(content)
    got = {r.artifact_id.rsplit("/", 1)[1]: r.md5 for r in artifact_md5(read_artifacts(spark, str(tmp_path))).collect()}
    assert got == {"lib.so.1": hashlib.md5(content).hexdigest()}


def test_run_catalogue_of_a_directory(spark, tmp_path):
    for folder in ("run-12024-01-31120001", "x2024-01-31-235959", "latest", "bad2024-13-01000000"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "uartlog").write_text("abc")
    listed = read_run_files(spark, str(tmp_path))
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    got = {r.run_name: (str(r.stamped_at), r.length) for r in run_catalog(listed).collect()}
    assert got == {
        "run-1": ("2024-01-31 12:00:01", 3),
        "x": ("2024-01-31 23:59:59", 3),
        "bad": ("None", 3),
    }


@pytest.mark.parametrize(
    "stdout, job_id",
    [
        ("Submitted batch job 12", 12),
        ("Submitted batch job 12\n", 12),
        ("Submitted batch job 12\n\n", -1),
        ("Submitted batch job 12 ", -1),
        (" Submitted batch job 12", -1),
        ("note\nSubmitted batch job 12", -1),
        ("Submitted batch job ", -1),
        ("Submitted batch job ٤٢", 42),
        ("Submitted batch job 99999999999999999999", -1),
        ("", -1),
        (None, -1),
    ],
)
def test_submissions(spark, stdout, job_id):
    log = spark.createDataFrame([(1, stdout)], "run_id bigint, stdout string")
    assert submission_parse(log).first().job_id == job_id


def test_a_byte_order_mark_is_no_part_of_a_name(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "AUTOCOUNTERFILE0.csv").write_bytes(b"\xef\xbb\xbf" + f"description,{CYCLES},x\nd,1,2\n".encode())
    options = {"header_line": 0, "data_line": 1}
    whole, lines = (as_rows(read_counter_samples(spark, str(tmp_path / "r"), n, **options)) for n in (10**6, 0))
    assert whole == lines and {r[3] for r in whole} == {CYCLES, "x"}


def test_artifacts_too_large_for_a_value(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / "large").write_bytes(b"x" * 5000)
    files = read_artifacts(spark, str(tmp_path), value_bytes=1000)
    got = {r.artifact_id.rsplit("/", 1)[1]: r.md5 for r in artifact_md5(files).collect()}
    assert got == {"small": "900150983cd24fb0d6963f7d28e17f72", "large": None}
    known = files.where("content is null").select("artifact_id", F.lit("supplied").alias("md5"))
    got = {r.artifact_id.rsplit("/", 1)[1]: r.md5 for r in artifact_md5(files, known).collect()}
    assert got == {"small": "900150983cd24fb0d6963f7d28e17f72", "large": "supplied"}
