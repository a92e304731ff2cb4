"""Print formatted plans: python tests/explain.py 0.01 counter_delta …"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from runscope.session import local_session  # noqa: E402

spark = local_session(8)
spark.sparkContext.setLogLevel("ERROR")
for name in sys.argv[2:]:
    print("=====", name)
    frame = entry.queries()[name](spark, f"/root/testdata/sf{sys.argv[1]}")
    frame.write.format("noop").mode("overwrite").save()
    frame.explain("formatted" if "-v" in sys.argv else "simple")
