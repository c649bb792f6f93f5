"""Invariants of the experiment results and behaviour jobs on the driver tables (sf0.01),
degenerate inputs, and an A/A check of the z-test."""


import pytest
from pyspark.sql import functions as F

from splitlens.operators import behaviour as B
from splitlens.operators import multitest as mt
from splitlens.operators import results as res
from splitlens.operators import stats as S
from splitlens.operators.assignment import variant_expr
from splitlens.pinned import EXP_ID, WINDOW_END, WINDOW_START
from splitlens.plans import QUERIES
from splitlens.sources.tables import read_table
from tests.conftest import SF01


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_expected_experiment_result(spark):
    got = {r["variant"]: r for r in rows(QUERIES["ab_result_total"](spark, SF01))}
    assert (got["A"]["units"], got["A"]["converted"], got["A"]["orders"]) == (744, 115, 123)
    assert (got["B"]["units"], got["B"]["converted"], got["B"]["orders"]) == (756, 133, 142)
    assert float(got["A"]["revenue"]) == 29404513.03
    assert float(got["B"]["revenue"]) == 36850978.65


def test_units_add_up_to_customers(spark):
    total = sum(r["units"] for r in rows(QUERIES["ab_result_total"](spark, SF01)))
    assert total == read_table(spark, SF01, "customer").count()


def test_daily_orders_add_up_to_total(spark):
    daily = rows(QUERIES["ab_result_daily"](spark, SF01))
    total = rows(QUERIES["ab_result_total"](spark, SF01))
    assert len(daily) == 2 * ((WINDOW_END - WINDOW_START).days + 1)
    for v in ("A", "B"):
        assert sum(r["orders"] for r in daily if r["variant"] == v) == \
            [r["orders"] for r in total if r["variant"] == v][0]
        assert sum(r["revenue"] for r in daily if r["variant"] == v) == \
            [r["revenue"] for r in total if r["variant"] == v][0]


def test_funnel_counts_and_monotone(spark):
    f = sorted(rows(QUERIES["funnel"](spark, SF01)), key=lambda r: r["step_no"])
    assert [r["user_days"] for r in f] == [1617, 345, 56]
    byv = rows(QUERIES["funnel_by_variant"](spark, SF01))
    for v in ("A", "B"):
        n = [r["user_days"] for r in sorted((r for r in byv if r["variant"] == v),
                                            key=lambda r: r["step_no"])]
        assert n == sorted(n, reverse=True)
    assert sum(r["user_days"] for r in byv) == sum(r["user_days"] for r in f)


def test_day0_retention_is_one(spark):
    for r in rows(QUERIES["retention_daily"](spark, SF01)):
        if r["day_n"] == 0:
            assert r["rate"] == 1.0


def test_adjusted_p_not_below_raw(spark):
    for m in mt.METHODS:
        for r in rows(QUERIES[f"mt_{m}"](spark, SF01)):
            assert r["p_adj"] >= r["p_value"] - 1e-6


def test_chi2_without_yates_is_z_squared(spark):
    total = QUERIES["ab_result_total"](spark, SF01)
    chi = rows(S.chi2_test(S.contingency(total), "variant", "outcome", correction=False))[0]
    z = rows(QUERIES["ztest_two_sample"](spark, SF01))[0]["z"]
    assert chi["statistic"] == pytest.approx(z * z, abs=1e-4)


def test_churn_features_use_only_pre_cutoff_orders(spark):
    f = QUERIES["churn_features"](spark, SF01)
    assert f.filter(F.col("recency_days") <= 0).count() == 0


# ---------------------------------------------------------------- degenerate inputs
def _result(spark, data):
    return spark.createDataFrame(data, "variant string, units long, converted long")


def test_zero_conversions_gives_null_statistics(spark):
    r = _result(spark, [("A", 100, 0), ("B", 100, 0)])
    chi = rows(S.chi2_test(S.contingency(r), "variant", "outcome"))[0]
    assert chi["statistic"] is None and chi["p_value"] is None
    z = rows(S.ztest_two_sample(S.wide_by_variant(r), "converted_A", "units_A",
                                "converted_B", "units_B"))[0]
    assert z["z"] is None and z["p_value"] is None


def test_all_converted_and_empty_group(spark):
    r = _result(spark, [("A", 10, 10), ("B", 0, 0)])
    z = rows(S.ztest_two_sample(S.wide_by_variant(r), "converted_A", "units_A",
                                "converted_B", "units_B"))[0]
    assert z["z"] is None
    post = rows(S.beta_posterior(r))
    assert {p["variant"]: (p["alpha"], p["beta"]) for p in post} == {"A": (11, 1), "B": (1, 1)}


def test_one_variant_only(spark):
    r = _result(spark, [("A", 10, 3)])
    chi = rows(S.chi2_test(S.contingency(r), "variant", "outcome"))[0]
    assert chi["dof"] == 0 and chi["statistic"] == 0.0 and chi["p_value"] == 1.0
    prob = rows(S.prob_b_beats_a(S.beta_posterior(r)))
    assert prob == [] or prob[0]["prob"] is None


def test_day_without_orders_is_zero_row(spark):
    c = read_table(spark, SF01, "customer")
    o = read_table(spark, SF01, "orders").filter(F.to_date("o_orderdate") != F.lit(WINDOW_START))
    d = rows(res.result_daily(spark, c, o, EXP_ID, WINDOW_START, WINDOW_END)
             .filter(F.col("day") == F.lit(WINDOW_START)))
    assert len(d) == 2 and all(r["orders"] == 0 and r["cvr"] == 0.0 for r in d)


# ---------------------------------------------------------------- A/A check
def test_aa_false_positive_rate(spark):
    """200 experiment ids on unchanged data: about 5% of p-values fall below 0.05."""
    c = read_table(spark, SF01, "customer").select("c_custkey")
    conv = (res.unit_metrics(read_table(spark, SF01, "orders"), WINDOW_START, WINDOW_END)
            .select(F.col("unit_id").alias("c_custkey"), F.lit(1).alias("conv")))
    ids = spark.range(200).select(F.concat(F.lit("aa-"), F.col("id").cast("string")).alias("exp"))
    x = (c.join(conv, "c_custkey", "left").crossJoin(F.broadcast(ids))
         .withColumn("variant", variant_expr(F.col("c_custkey"), F.col("exp")))
         .groupBy("exp", "variant")
         .agg(F.count(F.lit(1)).alias("units"), F.count("conv").alias("converted")))
    w = S.ztest_two_sample(S.wide_by_variant(x, ["exp"]), "converted_A", "units_A",
                           "converted_B", "units_B")
    share = w.agg(F.avg((F.col("p_value") < 0.05).cast("double"))).collect()[0][0]
    assert 0.0 <= share <= 0.12


def test_assignment_is_balanced_and_stable(spark):
    c = read_table(spark, SF01, "customer")
    a = c.select(variant_expr(F.col("c_custkey"), EXP_ID).alias("v")).groupBy("v").count()
    counts = {r["v"]: r["count"] for r in a.collect()}
    assert counts == {"A": 744, "B": 756}


def test_assignment_table_path_equals_hash_rule(spark):
    """Passing an explicit assignment table (joined on the unit id) gives the same results as
    the in-scan hash rule."""
    from splitlens.operators import assignment as asg
    c, o = read_table(spark, SF01, "customer"), read_table(spark, SF01, "orders")
    table = asg.assignment_table(c, "c_custkey", [EXP_ID, "exp-2"])
    a = asg.from_table(table, EXP_ID)
    for fn in (res.result_total,):
        want = sorted(map(tuple, fn(c, o, EXP_ID, WINDOW_START, WINDOW_END).collect()))
        got = sorted(map(tuple, fn(c, o, EXP_ID, WINDOW_START, WINDOW_END, assignments=a).collect()))
        assert got == want
    want = sorted(map(tuple, res.result_daily(spark, c, o, EXP_ID, WINDOW_START, WINDOW_END).collect()))
    got = sorted(map(tuple, res.result_daily(spark, c, o, EXP_ID, WINDOW_START, WINDOW_END,
                                             assignments=a).collect()))
    assert got == want


@pytest.mark.parametrize("with_table", [False, True])
def test_workflow_matches_registered_queries(spark, with_table):
    from splitlens.operators import assignment as asg
    from splitlens.operators.workflow import analyze_experiment
    c, o = read_table(spark, SF01, "customer"), read_table(spark, SF01, "orders")
    table = asg.from_table(asg.assignment_table(c, "c_custkey", [EXP_ID, "exp-2"]), EXP_ID) \
        if with_table else None
    out = analyze_experiment(spark, c, o, EXP_ID, WINDOW_START, WINDOW_END, assignments=table)
    for key, df in out.items():
        want = sorted(map(tuple, QUERIES[key](spark, SF01).collect()))
        assert sorted(map(tuple, df.collect())) == want, key


@pytest.mark.parametrize("key", ["ab_result_daily", "date_window", "kpi_weekly", "kpi_monthly",
                                 "heatmap", "retention_daily", "action_transitions",
                                 "churn_by_segment", "churn_features", "funnel"])
def test_results_do_not_depend_on_session_time_zone(spark, key):
    utc = sorted(map(tuple, QUERIES[key](spark, SF01).collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        other = sorted(map(tuple, QUERIES[key](spark, SF01).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert other == utc


def test_event_results_with_assignment_table(spark):
    from splitlens.operators import assignment as asg
    from splitlens.operators import behaviour as B
    ev = read_table(spark, SF01, "events")
    users = ev.select("user_id").distinct()
    table = asg.from_table(asg.assignment_table(users, "user_id", [EXP_ID, "exp-2"]), EXP_ID)
    pairs = [(res.entry_cvr(ev, EXP_ID), res.entry_cvr(ev, EXP_ID, assignments=table)),
             (res.ctr(ev, EXP_ID), res.ctr(ev, EXP_ID, assignments=table)),
             (B.funnel(ev, exp_id=EXP_ID), B.funnel(ev, exp_id=EXP_ID, assignments=table))]
    for want, got in pairs:
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
