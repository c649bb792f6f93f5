"""Experiment results for other experiment ids and windows against DuckDB."""

import datetime as dt

import pytest

from splitlens.operators import results as res
from splitlens.plans.common import duck_variant
from splitlens.sources.tables import read_table
from tests.conftest import SF01
from tests.harness import compare, duck_connection

CASES = [("exp-7", dt.date(1996, 1, 1), dt.date(1996, 3, 31)),
         ("checkout-2", dt.date(2000, 12, 25), dt.date(2001, 1, 3)),
         ("exp-1", dt.date(2003, 1, 1), dt.date(2003, 1, 7))]        # no orders at all


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF01)


def _window(start, end):
    return (f"o_orderdate >= TIMESTAMP '{start} 00:00:00' AND "
            f"o_orderdate < TIMESTAMP '{end} 00:00:00' + INTERVAL 1 DAY")


@pytest.mark.parametrize("exp_id,start,end", CASES)
def test_total_for_other_parameters(spark, con, exp_id, start, end):
    sql = f"""
    WITH u AS (SELECT c_custkey AS unit_id, {duck_variant('c_custkey', exp_id)} AS variant FROM customer),
    m AS (SELECT o_custkey AS unit_id, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS rev
          FROM orders WHERE {_window(start, end)} GROUP BY 1)
    SELECT variant, CAST(count(*) AS BIGINT) AS units, CAST(count(m.unit_id) AS BIGINT) AS converted,
           CAST(coalesce(sum(n), 0) AS BIGINT) AS orders,
           CAST(coalesce(sum(rev), 0) AS DECIMAL(18,2)) AS revenue,
           round(count(m.unit_id) / count(*), 4) AS cvr,
           round(coalesce(sum(n), 0) / count(*), 4) AS orders_per_unit,
           round(CAST(coalesce(sum(rev), 0) AS DOUBLE) / count(*), 4) AS revenue_per_unit
    FROM u LEFT JOIN m ON u.unit_id = m.unit_id GROUP BY variant"""

    def build(spark, sf):
        return res.result_total(read_table(spark, sf, "customer"), read_table(spark, sf, "orders"),
                                exp_id, start, end)
    r = compare(spark, con, "total", SF01, build, sql)
    assert r["ok"], r


@pytest.mark.parametrize("exp_id,start,end", CASES)
def test_daily_for_other_parameters(spark, con, exp_id, start, end):
    n_days = (end - start).days + 1
    sql = f"""
    WITH spine AS (SELECT CAST(DATE '{start}' + CAST(i AS INTEGER) AS DATE) AS day, v.variant
                   FROM range(0, {n_days}) r(i), (SELECT unnest(['A', 'B']) AS variant) v),
    u AS (SELECT {duck_variant('c_custkey', exp_id)} AS variant, count(*) AS units FROM customer GROUP BY 1),
    m AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n,
                 sum(CAST(o_totalprice AS DECIMAL(18,2))) AS rev
          FROM orders WHERE {_window(start, end)} GROUP BY 1, 2),
    dv AS (SELECT day, {duck_variant('o_custkey', exp_id)} AS variant, count(*) AS converted,
                  sum(n) AS orders, sum(rev) AS revenue FROM m GROUP BY 1, 2)
    SELECT spine.day, spine.variant, CAST(u.units AS BIGINT) AS units,
           CAST(coalesce(converted, 0) AS BIGINT) AS converted, CAST(coalesce(orders, 0) AS BIGINT) AS orders,
           CAST(coalesce(revenue, 0) AS DECIMAL(18,2)) AS revenue,
           round(coalesce(converted, 0) / u.units, 4) AS cvr
    FROM spine LEFT JOIN dv ON spine.day = dv.day AND spine.variant = dv.variant
    LEFT JOIN u ON spine.variant = u.variant"""

    def build(spark, sf):
        return res.result_daily(spark, read_table(spark, sf, "customer"),
                                read_table(spark, sf, "orders"), exp_id, start, end)
    r = compare(spark, con, "daily", SF01, build, sql)
    assert r["ok"], r


def test_funnel_other_steps(spark, con):
    steps = ("signup", "view", "purchase")
    sql = """
    WITH ev AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_type FROM events),
    s1 AS (SELECT user_id, day, min(ts) AS t FROM ev WHERE event_type = 'signup' GROUP BY 1, 2),
    s2 AS (SELECT ev.user_id, ev.day, min(ev.ts) AS t FROM ev JOIN s1 USING (user_id, day)
           WHERE ev.event_type = 'view' AND ev.ts > s1.t GROUP BY 1, 2),
    s3 AS (SELECT ev.user_id, ev.day, min(ev.ts) AS t FROM ev JOIN s2 USING (user_id, day)
           WHERE ev.event_type = 'purchase' AND ev.ts > s2.t GROUP BY 1, 2),
    c AS (SELECT 'signup' AS step, 1 AS step_no, count(*) AS n FROM s1
          UNION ALL SELECT 'view', 2, count(*) FROM s2 UNION ALL SELECT 'purchase', 3, count(*) FROM s3)
    SELECT step, CAST(step_no AS INTEGER) AS step_no, CAST(n AS BIGINT) AS user_days,
           round(CASE WHEN step_no = 1 THEN 1.0 ELSE n / nullif(lag(n) OVER (ORDER BY step_no), 0) END, 4)
             AS step_rate,
           round(n / nullif(first_value(n) OVER (ORDER BY step_no), 0), 4) AS total_rate
    FROM c"""
    from splitlens.operators import behaviour as B
    r = compare(spark, con, "funnel3", SF01,
                lambda s, d: B.funnel(read_table(s, d, "events"), steps), sql)
    assert r["ok"], r


def test_transitions_ten_minute_gap(spark, con):
    sql = """
    WITH l AS (SELECT event_type, ts,
                      lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p_type,
                      lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p_ts FROM events)
    SELECT p_type AS from_type, event_type AS to_type, CAST(count(*) AS BIGINT) AS n FROM l
    WHERE p_ts IS NOT NULL AND date_diff('microsecond', p_ts, ts) <= 600000000 GROUP BY 1, 2"""
    from splitlens.operators import behaviour as B
    r = compare(spark, con, "tr10", SF01,
                lambda s, d: B.transitions(read_table(s, d, "events"), 600), sql)
    assert r["ok"], r


def test_retention_three_days(spark, con):
    sql = """
    WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
    c AS (SELECT user_id, day, min(day) OVER (PARTITION BY user_id) AS cohort FROM a),
    sz AS (SELECT cohort, count(*) AS cohort_size FROM c WHERE day = cohort GROUP BY 1),
    act AS (SELECT cohort, CAST(date_diff('day', cohort, day) AS INTEGER) AS day_n, count(*) AS active
            FROM c GROUP BY 1, 2),
    spine AS (SELECT cohort, cohort_size, CAST(n AS INTEGER) AS day_n FROM sz, range(0, 4) r(n))
    SELECT CAST(spine.cohort AS DATE) AS cohort_day, spine.day_n, CAST(cohort_size AS BIGINT) AS cohort_size,
           CAST(coalesce(active, 0) AS BIGINT) AS active, round(coalesce(active, 0) / cohort_size, 4) AS rate
    FROM spine LEFT JOIN act ON spine.cohort = act.cohort AND spine.day_n = act.day_n"""
    from splitlens.operators import cohorts as C
    r = compare(spark, con, "ret3", SF01,
                lambda s, d: C.retention_daily(read_table(s, d, "events"), max_day=3), sql)
    assert r["ok"], r
