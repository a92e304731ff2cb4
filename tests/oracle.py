"""Run a query in Spark and its SQL twin in DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    if isinstance(value, float):
        return repr(value)
    return value


def _rows(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    frame = query(spark, sf_dir).toArrow()
    got_names, got = _rows(frame.column_names, zip(*[c.to_pylist() for c in frame.columns]))
    twin = con.execute(sql).to_arrow_table()
    want_names, want = _rows(twin.column_names, zip(*[c.to_pylist() for c in twin.columns]))
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    types = {c: (str(frame.schema.field(c).type), str(twin.schema.field(c).type)) for c in got_names}
    bad_types = {c: t for c, t in types.items() if t[0] != t[1]}
    if got != want:
        only_got, only_want = got - want, want - got
        return (
            f"rows {sum(got.values())}/{sum(want.values())},"
            f" only spark {list(only_got)[:2]}, only duckdb {list(only_want)[:2]}"
        )
    if bad_types:
        print("   types differ:", bad_types)
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from runscope.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    wanted = sys.argv[2:] or list(entry.queries())
    for name in wanted:
        query, sql = entry.queries()[name], entry.oracle_sql().get(name)
        begun = time.time()
        try:
            if sql is None:
                outcome = f"no twin, {query(spark, sf_dir).count()} rows"
            else:
                outcome = compare(spark, con, query, sql, sf_dir) or "equal"
        except Exception as e:  # keep going: this is a report
            outcome = "FAILED " + str(e)[:900]
        print(f"{name:24s} {time.time() - begun:6.2f}s {outcome}", flush=True)
