"""Plans for retention, churn and KPI jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitlens.operators import cohorts as C
from splitlens.operators import modeling as M
from splitlens.operators import selection as S
from splitlens.pinned import CHURN_CUTOFF, CHURN_HORIZON_DAYS, CHURN_REF_DATE
from splitlens.plans.registry import query
from splitlens.sources.tables import read_table


@query("retention_daily", """
WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
c AS (SELECT user_id, day, min(day) OVER (PARTITION BY user_id) AS cohort FROM a),
sz AS (SELECT cohort, count(*) AS cohort_size FROM c WHERE day = cohort GROUP BY 1),
act AS (SELECT cohort, CAST(date_diff('day', cohort, day) AS INTEGER) AS day_n, count(*) AS active
        FROM c GROUP BY 1, 2),
spine AS (SELECT cohort, cohort_size, CAST(n AS INTEGER) AS day_n FROM sz, range(0, 8) r(n))
SELECT CAST(spine.cohort AS DATE) AS cohort_day, spine.day_n,
       CAST(cohort_size AS BIGINT) AS cohort_size, CAST(coalesce(active, 0) AS BIGINT) AS active,
       round(coalesce(active, 0) / cohort_size, 4) AS rate
FROM spine LEFT JOIN act ON spine.cohort = act.cohort AND spine.day_n = act.day_n""")
def q_retention_daily(spark, sf):
    return C.retention_daily(read_table(spark, sf, "events"))


@query("retention_monthly", """
WITH a AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders),
c AS (SELECT o_custkey, m, min(m) OVER (PARTITION BY o_custkey) AS cohort FROM a),
g AS (SELECT cohort, CAST((year(m) * 12 + month(m)) - (year(cohort) * 12 + month(cohort)) AS INTEGER) AS month_n,
             count(*) AS active FROM c GROUP BY 1, 2)
SELECT CAST(cohort AS DATE) AS cohort_month, month_n,
       CAST(max(active) FILTER (WHERE month_n = 0) OVER (PARTITION BY cohort) AS BIGINT) AS cohort_size,
       CAST(active AS BIGINT) AS active,
       round(active / max(active) FILTER (WHERE month_n = 0) OVER (PARTITION BY cohort), 4) AS rate
FROM g""")
def q_retention_monthly(spark, sf):
    return C.retention_monthly(read_table(spark, sf, "orders"))


@query("churn_by_segment", f"""
WITH act AS (SELECT DISTINCT o_custkey FROM orders
             WHERE o_orderdate >= TIMESTAMP '{CHURN_REF_DATE.isoformat()}' - INTERVAL {CHURN_HORIZON_DAYS} DAY
               AND o_orderdate < TIMESTAMP '{CHURN_REF_DATE.isoformat()}')
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS customers,
       CAST(count(*) FILTER (WHERE act.o_custkey IS NULL) AS BIGINT) AS churned,
       round((count(*) FILTER (WHERE act.o_custkey IS NULL)) / count(*), 4) AS churn_rate
FROM customer LEFT JOIN act ON customer.c_custkey = act.o_custkey
GROUP BY 1""")
def q_churn_by_segment(spark, sf):
    return C.churn_by_segment(read_table(spark, sf, "customer"), read_table(spark, sf, "orders"),
                              CHURN_REF_DATE, CHURN_HORIZON_DAYS)


_CUT = f"TIMESTAMP '{CHURN_CUTOFF.isoformat()}'"


_FEATURES_SQL = f"""
WITH f AS (
  SELECT o_custkey,
         max(o_orderdate) FILTER (WHERE o_orderdate < {_CUT}) AS last_ts,
         count(*) FILTER (WHERE o_orderdate < {_CUT}) AS frequency,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderdate < {_CUT}) AS monetary,
         count(*) FILTER (WHERE o_orderdate >= {_CUT}) AS after_n
  FROM orders GROUP BY 1)
SELECT o_custkey AS c_custkey,
       CAST(date_diff('day', CAST(last_ts AS DATE), DATE '{CHURN_CUTOFF.isoformat()}') AS INTEGER) AS recency_days,
       CAST(frequency AS BIGINT) AS frequency, CAST(monetary AS DECIMAL(18,2)) AS monetary,
       CAST(CASE WHEN after_n = 0 THEN 1 ELSE 0 END AS INTEGER) AS churned
FROM f WHERE frequency > 0"""


@query("churn_features", _FEATURES_SQL)
def q_churn_features(spark, sf):
    return C.churn_features(read_table(spark, sf, "orders"), CHURN_CUTOFF)


@query("churn_model")
def q_churn_model(spark, sf):
    feats = C.churn_features(read_table(spark, sf, "orders"), CHURN_CUTOFF)
    return M.churn_model(feats)


@query("churn_evaluation")
def q_churn_evaluation(spark, sf):
    return M.churn_evaluation(M.churn_scores(C.churn_features(read_table(spark, sf, "orders"), CHURN_CUTOFF)))


def _feature_auc_sql(feature: str) -> str:
    # Mann-Whitney by average ranks, independent of the counting in the engine
    return f"""SELECT '{feature}' AS score, CAST(sum(churned) AS BIGINT) AS positives, CAST(sum(1 - churned) AS BIGINT) AS negatives,
       round((sum(CASE WHEN churned = 1 THEN (lo + hi) / 2.0 END) - sum(churned) * (sum(churned) + 1) / 2.0)
             / nullif(sum(churned) * sum(1 - churned), 0), 6) AS auc
FROM (SELECT churned, rank() OVER (ORDER BY {feature}) AS lo,
             rank() OVER (ORDER BY {feature}) + count(*) OVER (PARTITION BY {feature}) - 1 AS hi FROM h)"""


@query("churn_feature_auc", f"""WITH g AS ({_FEATURES_SQL}),
h AS (SELECT * FROM g WHERE ('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 7))::BIGINT % 5 = 0)
""" + "\nUNION ALL\n".join(_feature_auc_sql(c) for c in M.CHURN_FEATURES))
def q_churn_feature_auc(spark, sf):
    feats = C.churn_features(read_table(spark, sf, "orders"), CHURN_CUTOFF).filter(M.held_out("c_custkey"))
    return S.rank_auc(feats, "churned", M.CHURN_FEATURES).withColumn("auc", F.round("auc", 6))


def _kpi_sql(grain: str) -> str:
    return f"""
WITH pc AS (SELECT CAST(date_trunc('{grain}', o_orderdate) AS DATE) AS period, o_custkey,
                   count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS rev
            FROM orders GROUP BY 1, 2),
g AS (SELECT period, sum(n) AS orders, count(*) AS customers, sum(rev) AS revenue FROM pc GROUP BY 1)
SELECT period, CAST(orders AS BIGINT) AS orders, CAST(customers AS BIGINT) AS customers,
       CAST(revenue AS DECIMAL(18,2)) AS revenue,
       CAST(lag(revenue) OVER (ORDER BY period) AS DECIMAL(18,2)) AS revenue_prev,
       round(CAST(revenue AS DOUBLE) / CAST(lag(revenue) OVER (ORDER BY period) AS DOUBLE) - 1, 4)
         AS revenue_growth
FROM g"""


@query("kpi_weekly", _kpi_sql("week"))
def q_kpi_weekly(spark, sf):
    return C.kpi(read_table(spark, sf, "orders"), "week")


@query("kpi_monthly", _kpi_sql("month"))
def q_kpi_monthly(spark, sf):
    return C.kpi(read_table(spark, sf, "orders"), "month")
