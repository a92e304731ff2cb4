"""Time a plain pandas loop, one run at a time, against the Spark parser on the same files.

Both read the counter texts of sf0.1's runs from parquet and compute final values and deltas.
"""

import io
import sys
import tempfile
import time
from pathlib import Path

import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from runscope import fixtures as fx  # noqa: E402
from runscope.formats import CYCLES, DATA_LINE, HEADER_LINE  # noqa: E402
from runscope.operators.metrics import counter_final  # noqa: E402
from runscope.operators.series import counter_delta, warmup_drop  # noqa: E402
from runscope.session import local_session  # noqa: E402
from runscope.sources.counters import counter_scan  # noqa: E402

SKIPPED = [i for i in range(DATA_LINE) if i != HEADER_LINE]

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/texts"
    fx.counter_files(spark, sf_dir).repartition(32).write.parquet(folder)

    begun = time.perf_counter()
    rows = 0
    for text in pd.read_parquet(folder)["value"]:
        table = pd.read_csv(io.StringIO(text), skiprows=SKIPPED, na_values=["n/a"]).drop(columns=["description"])
        table = table.iloc[6:].fillna(0).astype("int64").reset_index(drop=True)
        table.iloc[-1:].to_dict()
        diff = table.diff().fillna(0)
        diff[CYCLES] = table[CYCLES]
        rows += diff.size
    print(f"pandas loop: {time.perf_counter() - begun:.2f} s for {rows} cells")

    for attempt in range(2):
        begun = time.perf_counter()
        samples = warmup_drop(counter_scan(spark.read.parquet(folder)))
        counter_final(samples).write.format("noop").mode("overwrite").save()
        counter_delta(samples).write.format("noop").mode("overwrite").save()
        print(f"Spark, 8 cores, run {attempt + 1}: {time.perf_counter() - begun:.2f} s, both results, parsed twice")
    begun = time.perf_counter()
    counter_scan(spark.read.parquet(folder)).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - begun
    cells = counter_scan(spark.read.parquet(folder)).count()
    print(f"Spark parser alone: {took:.2f} s, {cells / took:,.0f} cells/s")
