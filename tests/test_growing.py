"""Logs that grow give the batch result after each call."""

import pytest

from runscope.operators.metrics import uart_last_wins
from runscope.sources.logs import read_log_tokens
from runscope.streaming import growing
from runscope.streaming.growing import appended, follow_logs, metrics_in, read_followed


def batch(spark, dirs):
    tokens = read_log_tokens(spark, dirs, name="uartlog")
    return {(r.run_id, r.name): r.value for r in uart_last_wins(tokens).collect()}


def test_a_log_appended_three_times(spark, tmp_path):
    dirs, out, state = f"{tmp_path}/runs/*", str(tmp_path / "out"), str(tmp_path / "state")

    def append(run, text, mode="a"):
        (tmp_path / "runs" / run).mkdir(parents=True, exist_ok=True)
        with open(tmp_path / "runs" / run / "uartlog", mode, encoding="utf-8") as f:
            f.write(text)

    def followed():
        follow_logs(spark, dirs, out, state)
        return {(r.run_id, r.name): r.value for r in read_followed(spark, out).collect()}

    append("a", "boot YUKON_INSTRUCTIONS=10 YUKON_ERROR_X=1\nYUKON_CLI")
    append("b 1", "YUKON_VIEW=٣ YUKON_É_Z=7")  # the last token may still grow
    append("empty", "")
    assert followed() == batch(spark, dirs) == {("a", "instructions"): 10.0, ("a", "error"): 1.0, ("b 1", "view"): 3.0, ("b 1", "é"): 7.0}
    append("a", "CK=5\nYUKON_INSTRUCTIONS=20")
    append("b 1", "77 YUKON_VIEW=4\r\n")
    assert followed() == batch(spark, dirs)
    append("a", "00\n" + "x" * 100 + " YUKON_ERROR=9\n")
    append("c", "YUKON_ERROR=2\n")
    assert followed() == batch(spark, dirs) and followed()["a", "instructions"] == 2000.0
    files = sum(1 for _ in (tmp_path / "out").rglob("*.parquet"))
    assert followed() == batch(spark, dirs) and files >= 1  # nothing new
    append("a", "YUKON_NEW=1\n", "w")  # another log in its place
    assert followed() == batch(spark, dirs) and ("a", "error") not in followed()


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_pieces_cut_no_token(tmp_path, monkeypatch, size):
    monkeypatch.setattr(growing, "READ_BYTES", size)
    data = "xé YUKON_A=12\tYUKON_B=3\n\nYUKON_A=45 YUKON_C_D=678 ü YUKON_E=9".encode()
    (tmp_path / "f").write_bytes(data)
    for begin in (0, 4):
        found, end = {}, 0
        for end, part, final in appended(f"file://{tmp_path}/f", begin, len(data)):
            found.update(part)
        assert found == metrics_in(data[begin:]) == {"a": 45.0, "b": 3.0, "c": 678.0, "e": 9.0} and not final
        assert data[end:] == b"YUKON_E=9"
    short = list(appended(f"file://{tmp_path}/f", 0, 14))  # only what the listing saw
    assert {k: v for _, p, _ in short for k, v in p.items()} == {"a": 12.0}
