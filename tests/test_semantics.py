"""Parsers against plain Python and pandas on many random inputs, one Spark job each."""

import io
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from runscope.functions.text import run_name_valid, strip_whitespace
from runscope.operators.metrics import counter_final, uart_last_wins
from runscope.operators.series import counter_delta, warmup_drop
from runscope.sources.counters import counter_scan
from runscope.sources.logs import submission_parse, uart_scan

PIECES = [
    "YUKON_", "YUKON", "_", "=", "A", "b", "é", "中", "ß", "1", "07", "٣", "²", "Ⅷ", "½", "𝟗", "𐐀", " ", "\t", "\n", "\r\n",
    "-", ".", "x=5", "INSTRUCTIONS=", "YUKON_L1_HTLB_MISS=", "YUKON__=", "9" * 30,
]


def test_random_logs(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(40))) for _ in range(3000)]
    want, last = {}, {}
    for run, text in enumerate(texts):
        for pos, token in enumerate(re.findall(r"YUKON_\w+=\d+", text)):
            name, value = token.split("=")
            want[(run, pos)] = (name.split("_")[1].lower(), float(value))
            last[(run, name.split("_")[1].lower())] = float(value)
    assert len(want) > 300
    files = spark.createDataFrame(list(enumerate(texts)), "run_id bigint, value string").repartition(8)
    tokens = uart_scan(files).cache()
    assert {(r.run_id, r.pos): (r.name, r.value) for r in tokens.collect()} == want
    assert {(r.run_id, r.name): r.value for r in uart_last_wins(tokens).collect()} == last
    tokens.unpersist()


def random_counter_file(rng):
    names = rng.sample(["a", "b", "c c", '"d, d"', "a.1", "e"], k=rng.randrange(1, 5))
    if rng.random() < 0.3:
        names.append("e" if "e" in names else names[0])
    at = rng.randrange(len(names) + 1)
    header = names[:at] + ["description"] + names[at:]
    end = rng.choice(["\n", "\r\n"])
    lines = ["p1", "p,2", "", ",".join(header), "t", "", '"q"'] if rng.random() < 0.5 else ["p"] * 3 + [",".join(header)] + ["q"] * 3

    def cell():
        number = rng.randrange(10**6)
        return rng.choice([str(number), f" {number}", f"{number}.{rng.randrange(100)}", f"{number}e1", f'"{number}"', f"+{number}"])

    for _ in range(rng.randrange(6, 20)):
        cells = [cell() for _ in names]
        lines.append(",".join(cells[:at] + [rng.choice(["x", "", '"y, z"', '"say ""hi"""'])] + cells[at:]))
        if rng.random() < 0.15:
            lines.append(rng.choice(["", " ", "\t ", "   "]))
    return end.join(lines) + rng.choice(["", end, end + end])


def test_random_counter_files(spark):
    """As pandas reads them, wherever its reading is unambiguous."""
    rng = random.Random(12)
    texts = [random_counter_file(rng) for _ in range(400)]
    samples, finals, deltas = {}, {}, {}
    for run, text in enumerate(texts):
        table = pd.read_csv(io.StringIO(text), skiprows=[0, 1, 2, 4, 5, 6]).drop(columns=["description"])
        for name in table.columns:
            kept = list(table[name].iloc[6:].astype(int))
            changes = pd.Series(kept, dtype="int64").diff().fillna(0)
            for i, value in enumerate(kept):
                samples[(run, name, i)] = value
                deltas[(run, name, i)] = changes[i]
            if kept:
                finals[(run, name)] = kept[-1]
    files = spark.createDataFrame(list(enumerate(texts)), "run_id bigint, value string").repartition(8)
    parsed = warmup_drop(counter_scan(files)).cache()
    assert {(r.run_id, r.counter, r.sample_idx): r.value for r in parsed.collect()} == samples
    assert {(r.run_id, r.name): r.value for r in counter_final(parsed).collect()} == finals
    got = {(r.run_id, r.counter, r.sample_idx): r.delta for r in counter_delta(parsed, block=4).collect()}
    assert got == deltas and len(got) > 5000
    parsed.unpersist()


def test_random_names_messages_and_descriptions(spark):
    rng = random.Random(13)
    pieces = list("aZ09.-_ /:\n\r\t\x0b\x0c\x1c\x1f\x85\xa0 　éß") + ["Submitted batch job ", "12", "٣"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(6))) for _ in range(5000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "run_id bigint, stdout string")
    got = frame.select("run_id", run_name_valid(F.col("stdout")).alias("v"), strip_whitespace(F.col("stdout")).alias("s"))
    for r in got.collect():
        text = texts[r.run_id]
        assert r.v == (re.fullmatch(r"[a-zA-Z0-9.\-_]+", text) is not None), repr(text)
        assert r.s == text.strip(), repr(text)
    for r in submission_parse(frame).collect():
        match = re.match(r"^Submitted batch job (\d+)$", texts[r.run_id])
        assert r.job_id == (int(match[1]) if match else -1), repr(texts[r.run_id])
