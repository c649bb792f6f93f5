"""Plan-shape guards: the properties the scale design relies on, read from executed plans."""

import re

from splitlens.plans import QUERIES
from tests.conftest import SF01


def final_plan(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Final Plan" in plan:
        plan = plan[plan.find("Final Plan"):plan.find("Initial Plan")]
    return plan


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_flagship_pushes_window_and_prunes_columns(spark):
    text = formatted(QUERIES["ab_result_total"](spark, SF01))
    assert re.search(r"PushedFilters: \[IsNotNull\(o_orderdate\), GreaterThanOrEqual\(o_orderdate,1997-05-13T00:00\), "
                     r"LessThan\(o_orderdate,1997-06-24T00:00\)", text)
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in text
    assert "ReadSchema: struct<c_custkey:bigint>" in text


def test_flagship_never_joins_fact_rows(spark):
    plan = final_plan(QUERIES["ab_result_total"](spark, SF01))
    joins = re.findall(r"(\w+Join)", plan)
    assert len(joins) == 1                         # population and per-unit aggregate, one row per unit each
    assert plan.count("FileScan") == 2
    assert "partial_sum" in plan and "keys=[o_custkey" in plan   # fact rows are aggregated below the join


def test_transitions_one_scan_no_join(spark):
    plan = final_plan(QUERIES["action_transitions"](spark, SF01))
    assert plan.count("FileScan") == 1
    assert "Join" not in plan


def test_funnel_one_scan_no_join(spark):
    plan = final_plan(QUERIES["funnel"](spark, SF01))
    assert plan.count("FileScan") == 1
    assert "Join" not in plan


def test_ranks_and_quantiles_do_not_sort_the_rows(spark):
    for key in ("rfm_segments", "user_score", "box_stats"):
        plan = final_plan(QUERIES[key](spark, SF01))
        assert "ntile(" not in plan and "percent_rank(" not in plan and "row_number()" not in plan, key
        assert "rangepartitioning" not in formatted(QUERIES[key](spark, SF01)), key
    assert "ExistingRDD" not in final_plan(QUERIES["user_score"](spark, SF01))     # nothing is checkpointed


def test_dedup_is_an_aggregate_not_a_window(spark):
    plan = final_plan(QUERIES["clean_logs"](spark, SF01))
    assert "Window" not in plan and "min_by" in plan
