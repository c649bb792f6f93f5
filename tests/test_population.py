"""Inputs that the given tables lack: orphan and NULL units, absent cells, many degrees of freedom."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from splitlens.functions.numeric import chi2_sf, harmonic
from splitlens.operators import profile as P
from splitlens.operators import results as res
from splitlens.operators import stats as S
from splitlens.operators.assignment import variant_expr
from splitlens.session import shared_dir
from splitlens.sources import files
from splitlens.streaming import daily_results_stream, orders_stream

START, END = dt.date(1997, 1, 1), dt.date(1997, 1, 31)


@pytest.fixture(scope="module")
def tables(spark):
    customer = spark.createDataFrame([(i, "S") for i in (1, 2, 3, 4, None)], "c_custkey long, c_mktsegment string")
    day = dt.datetime(1997, 1, 5)
    orders = spark.createDataFrame([(i, k, 10.0, day) for i, k in enumerate([1, 2, 2, 91, 92, 93, 94, None, None])],
                                   "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz")
    return customer, orders


def test_only_the_population_counts(spark, tables):
    total = res.result_total(*tables, "e", START, END).agg(F.sum("units"), F.sum("converted"), F.sum("orders"), F.max("cvr")).first()
    assert tuple(total)[:3] == (4, 2, 3) and total[3] <= 1
    segment = res.segment_result(*tables, "e", START, END).agg(F.sum("units"), F.sum("converted")).first()
    assert tuple(segment) == (4, 2)
    daily = res.result_daily(spark, *tables, "e", START, END)
    assert daily.agg(F.sum("orders"), F.sum("converted")).first()[:] == (3, 2)


def test_null_units_have_no_variant(spark):
    units = spark.createDataFrame([(None,), (1,)], "u long")
    got = {r["u"]: r["v"] for r in units.withColumn("v", variant_expr("u", "e")).collect()}
    assert got[None] is None and got[1] in ("A", "B")
    events = spark.createDataFrame([(None, dt.datetime(1997, 1, 1), "view"), (1, dt.datetime(1997, 1, 1), "view")],
                                   "user_id long, ts timestamp_ntz, event_type string")
    assert [r["views"] for r in res.ctr(events, "e").collect()] == [1]
    assert [r["user_days"] for r in res.entry_cvr(events, "e").collect()] == [1]


@pytest.mark.parametrize("stat,dof,p", [(410, 410, 0.4907), (500, 500, 0.4916), (401, 500, 0.9996), (5000, 5000, 0.4973), (390, 390, 0.4905)])
def test_chi_square_tail_of_many_degrees(spark, stat, dof, p):
    got = spark.range(1).select(F.lit(stat).alias("x"), F.lit(dof).alias("d")).select(chi2_sf("x", "d")).first()[0]
    assert got == pytest.approx(p, abs=2e-4)


def test_absent_cells_count_as_zero(spark):
    cells = [("A", "s1", 10), ("B", "s1", 10), ("A", "s2", 30)]
    for more in ([], [("B", "s2", 0)]):
        df = spark.createDataFrame(cells + more, "r string, c string, n long")
        got = S.chi2_test(df, "r", "c").first()
        plain = S.chi2_test(df, "r", "c", correction=False).first()
        # margins 40, 10 and 20, 30 of 50: every cell is 6 away from its expectation
        e = [16, 24, 4, 6]
        assert got["statistic"] == pytest.approx(sum(5.5 ** 2 / x for x in e), abs=1e-6)
        assert plain["statistic"] == pytest.approx(sum(36 / x for x in e), abs=1e-6)


def test_harmonic_is_one_formula(spark):
    df = spark.createDataFrame([(m,) for m in (1, 2, 10, 999, 1000, 1001, 5000)], "m long")
    for r in df.withColumn("h", harmonic("m")).collect():
        assert r["h"] == pytest.approx(sum(1 / j for j in range(1, r["m"] + 1)), abs=1e-9)


def test_margin_and_given_variance(spark):
    df = spark.createDataFrame([(30, 100, 25, 100)], "x1 long, n1 long, x2 long, n2 long")
    z = S.ztest_two_sample(df, "x1", "n1", "x2", "n2", value=0.02, prop_var=0.25).first()["z"]
    assert z == pytest.approx((0.05 - 0.02) / (0.25 * 0.75 * 0.02) ** 0.5)


def test_user_score_keeps_null_metrics(spark):
    df = spark.createDataFrame([(1, None, 1), (2, 5.0, 1), (3, 7.0, 1)], "user_id long, total_value double, n long")
    assert P.user_score(df, ["total_value", "n"]).count() == 3


def test_delimited_text_is_lossless(spark):
    rows = [(1, None, 2, " pad ", 1.5, ""), (2, dt.datetime(2024, 1, 1, 3), None, "two\nlines, \"q\"\t", None, None)]
    df = spark.createDataFrame(rows, files.EVENTS_SCHEMA)
    for sep in (",", "\t"):
        back = files.roundtrip_csv(spark, df, files.EVENTS_SCHEMA, "lossless", sep)
        assert sorted(map(tuple, back.collect())) == rows


def test_stream_over_many_unordered_files_equals_batch(spark, tables):
    customer, _ = tables
    days = [dt.datetime(1997, 1, 1) + dt.timedelta(days=(7 * i) % 31) for i in range(40)]
    orders = spark.createDataFrame([(i, 1 + i % 4, "O", 5.0, d, "1") for i, d in enumerate(days)]
                                   + [(99, 1, "O", 5.0, dt.datetime(1997, 12, 31), "1")],
                                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    src, ckpt, out = (shared_dir(spark, n) for n in ("u-src", "u-ckpt", "u-out"))
    orders.repartition(9).write.mode("overwrite").parquet(src)
    q = (daily_results_stream(orders_stream(spark, src), customer, "e", START, END).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    batch = res.result_daily(spark, customer, orders, "e", START, END).filter("orders > 0")
    assert sorted(map(tuple, spark.read.parquet(out).select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))
