"""What no plan may hold, and what some must."""

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from runscope.queries import QUERIES
from runscope import fixtures as fx
from runscope.operators.traces import roi_slice

SF_DIR = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "EvalPython", "MapInPandas", "FlatMapGroups")


def plan_of(spark, name):
    return entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_plan_gathers_crosses_or_leaves_the_jvm(spark, name):
    plan = plan_of(spark, name)
    # the menu adds up one row per partition in one task
    allowed = ["SinglePartition"] if name == "config_menu" else []
    assert [f for f in FORBIDDEN if f in plan] == allowed


@pytest.mark.parametrize(
    "name, part",
    [
        ("latest_pointer", "row_number(), 1, Partial"),
        ("latest_pointer_global", "TakeOrderedAndProject(limit=1"),
        ("config_menu", "BroadcastExchange"),
        ("counter_final", "partial_max_by"),
        ("config_complete", "partial_max"),
        ("roi_slice", "BroadcastHashJoin"),
        ("host_walltime", "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>"),
        ("config_complete", "l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_tax:double,l_returnflag:string,l_linestatus:string"),
    ],
)
def test_plan_has(spark, name, part):
    frame = entry.queries()[name](spark, SF_DIR)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = frame._jdf.queryExecution().executedPlan().toString() + frame._jdf.queryExecution().explainString(mode)
    assert part in plan


def test_marker_filters_reach_the_scan(spark):
    events = fx.table(spark, SF_DIR, "events").withColumnRenamed("user_id", "run_id")
    kind = F.col("event_type")
    frame = roi_slice(events, kind == "signup", kind == "purchase", "event_id")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = frame._jdf.queryExecution().explainString(mode)
    assert "EqualTo(event_type,signup)" in plan and "EqualTo(event_type,purchase)" in plan


@pytest.mark.parametrize("name", ["uart_scan", "counter_scan", "warmup_drop", "artifact_md5", "run_catalog", "submission_parse", "hue_split"])
def test_row_local_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan_of(spark, name)


@pytest.mark.parametrize("name", ["counter_final", "config_complete", "host_walltime"])
def test_one_shuffle(spark, name):
    assert plan_of(spark, name).count("Exchange") == 1


@pytest.mark.parametrize("name", ["mpki_report", "uart_last_wins"])
def test_aggregations(spark, name):
    plan = plan_of(spark, name)
    assert ("SortAggregate" in plan) == (name == "uart_last_wins")
