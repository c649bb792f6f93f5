"""Plans for profiles, segmentation, scores, metric registry and the price model
(N10-N13, N18-N20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitlens.operators import metrics as MR
from splitlens.operators import modeling as M
from splitlens.operators import profile as P
from splitlens.pinned import MONEY
from splitlens.plans.registry import query
from splitlens.sources.tables import read_table

_ORDERS_COLS = [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "str"),
                ("o_totalprice", "float"), ("o_orderdate", "ts"), ("o_orderpriority", "str")]


def _profile_sql() -> str:
    parts = []
    for c, kind in _ORDERS_COLS:
        if kind == "float":
            lo = f"CAST(CAST(min({c}) AS DECIMAL(38,4)) AS VARCHAR)"
            hi = f"CAST(CAST(max({c}) AS DECIMAL(38,4)) AS VARCHAR)"
        else:
            lo, hi = f"CAST(min({c}) AS VARCHAR)", f"CAST(max({c}) AS VARCHAR)"
        mean = (f"round(avg(CAST({c} AS DOUBLE)), 4)" if kind in ("int", "float")
                else "CAST(NULL AS DOUBLE)")
        parts.append(f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS rows,
       CAST(count(*) - count({c}) AS BIGINT) AS nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS "distinct",
       {lo} AS min_txt, {hi} AS max_txt, {mean} AS mean FROM orders""")
    return "\nUNION ALL\n".join(parts)


@query("eda_profile", _profile_sql())
def q_eda_profile(spark, sf):
    return P.eda_profile(read_table(spark, sf, "orders"))


@query("histogram", """
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 20.0 AS w
           FROM orders),
b AS (SELECT CAST(CASE WHEN w > 0 THEN least(20, floor((o_totalprice - lo) / w) + 1) ELSE 1 END AS INTEGER) AS bucket
      FROM orders, s WHERE o_totalprice IS NOT NULL),
c AS (SELECT bucket, count(*) AS n FROM b GROUP BY 1)
SELECT CAST(r.i AS INTEGER) AS bucket, round(lo + (r.i - 1) * w, 4) AS lo, round(lo + r.i * w, 4) AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM range(1, 21) r(i) CROSS JOIN s LEFT JOIN c ON c.bucket = r.i""")
def q_histogram(spark, sf):
    return P.histogram(read_table(spark, sf, "orders"), "o_totalprice", 20)


@query("box_stats", """
WITH q AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1,
                  quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3
           FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1)
SELECT q.o_orderstatus, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(min(o_totalprice) FILTER (WHERE o_totalprice >= q1 - 1.5 * (q3 - q1)), 4) AS lo_whisker,
       round(max(o_totalprice) FILTER (WHERE o_totalprice <= q3 + 1.5 * (q3 - q1)), 4) AS hi_whisker
FROM orders JOIN q ON orders.o_orderstatus = q.o_orderstatus
GROUP BY q.o_orderstatus, q1, median, q3""")
def q_box_stats(spark, sf):
    return P.box_stats(read_table(spark, sf, "orders"), "o_totalprice", "o_orderstatus")


@query("scatter_sample", """
SELECT p_partkey, p_size, p_retailprice FROM part
WHERE ('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 7))::BIGINT % 100 < 10""")
def q_scatter_sample(spark, sf):
    return P.hash_sample(read_table(spark, sf, "part"), "p_partkey", 10) \
        .select("p_partkey", "p_size", "p_retailprice")


@query("correlation", """
SELECT round(corr(p_size, p_retailprice), 6) AS corr, CAST(count(*) AS BIGINT) AS n
FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL""")
def q_correlation(spark, sf):
    return P.correlation(read_table(spark, sf, "part"), "p_size", "p_retailprice")


@query("rfm_segments", """
WITH per AS (SELECT o_custkey AS c_custkey, max(o_orderdate) AS last_ts, count(*) AS freq,
                    coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS mon FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1),
t AS (SELECT c_custkey, CAST(ntile(5) OVER (ORDER BY last_ts NULLS FIRST, c_custkey) AS INTEGER) AS r,
             CAST(ntile(5) OVER (ORDER BY freq, c_custkey) AS INTEGER) AS f,
             CAST(ntile(5) OVER (ORDER BY mon, c_custkey) AS INTEGER) AS m FROM per)
SELECT c_custkey, r, f, m, CAST(r AS VARCHAR) || CAST(f AS VARCHAR) || CAST(m AS VARCHAR) AS segment FROM t""")
def q_rfm_segments(spark, sf):
    return P.rfm_segments(read_table(spark, sf, "orders"))


def user_metrics(events):
    return (events.groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("events"),
                 F.count_if(F.col("event_type") == "purchase").alias("purchases"),
                 F.sum(F.col("value").cast(MONEY)).alias("total_value")))


@query("user_score", """
WITH u AS (SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
                  sum(CAST(value AS DECIMAL(18,2))) AS total_value FROM events GROUP BY 1)
SELECT user_id, round((percent_rank() OVER (ORDER BY events) + percent_rank() OVER (ORDER BY purchases)
                       + percent_rank() OVER (ORDER BY total_value)) / 3.0, 6) AS score
FROM u""")
def q_user_score(spark, sf):
    return P.user_score(user_metrics(read_table(spark, sf, "events")),
                        ["events", "purchases", "total_value"])


def _registry_sql() -> str:
    g = "\nUNION ALL\n".join(
        f"""SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS dim_value, count(*) AS orders,
       sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue,
       round(avg(o_totalprice), 4) AS avg_order_value FROM orders GROUP BY {d}"""
        for d in ("o_orderstatus", "o_orderpriority"))
    cols = "\nUNION ALL\n".join(
        f"SELECT dim, dim_value, '{m}' AS metric, round(CAST({m} AS DOUBLE), 4) AS value FROM g"
        for m in ("orders", "revenue", "avg_order_value"))
    return f"WITH g AS ({g})\n{cols}"


@query("metric_registry", _registry_sql())
def q_metric_registry(spark, sf):
    return MR.long_form(read_table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"],
                        ["orders", "revenue", "avg_order_value"])


@query("price_model")
def q_price_model(spark, sf):
    return M.price_model(read_table(spark, sf, "part"))


_PRICE_CTE = """
r AS (SELECT p_partkey, p_brand, p_retailprice, CAST(coalesce(p_size, 0) AS DOUBLE) AS x, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS y,
             ('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 7))::BIGINT % 5 = 0 AS held_out FROM part),
t AS (SELECT * FROM r WHERE NOT held_out AND y IS NOT NULL),
c AS (SELECT p_brand, avg(x) AS mx, avg(y) AS my FROM t GROUP BY p_brand),
s AS (SELECT coalesce(sum((x - mx) * (y - my)) / nullif(sum((x - mx) * (x - mx)), 0), 0) AS slope
      FROM t JOIN c ON t.p_brand IS NOT DISTINCT FROM c.p_brand),
a AS (SELECT avg(x) AS ax, avg(y) AS ay FROM t),
p AS (SELECT p_partkey, p_retailprice, held_out, round(coalesce(my - slope * mx, ay - slope * ax) + slope * x, 4) AS prediction
      FROM r LEFT JOIN c ON r.p_brand IS NOT DISTINCT FROM c.p_brand, s, a)"""


@query("price_regression", f"WITH {_PRICE_CTE}\nSELECT p_partkey, prediction, held_out FROM p")
def q_price_regression(spark, sf):
    return M.price_regression(read_table(spark, sf, "part")).select("p_partkey", "prediction", "held_out")


@query("price_evaluation", f"""WITH {_PRICE_CTE}
SELECT held_out, CAST(count(*) AS BIGINT) AS parts, round(avg(abs(prediction - p_retailprice)), 4) AS mae,
       round(sqrt(avg(power(prediction - p_retailprice, 2))), 4) AS rmse,
       round(1 - avg(power(prediction - p_retailprice, 2)) / nullif(var_pop(p_retailprice), 0), 4) AS r2
FROM p WHERE p_retailprice IS NOT NULL GROUP BY held_out""")
def q_price_evaluation(spark, sf):
    return M.price_evaluation(M.price_regression(read_table(spark, sf, "part")))
