"""Plans for sources/parameters (S1, F1-F4) and experiment results."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitlens.operators import assignment as asg
from splitlens.operators import results as res
from splitlens.pinned import EXP_ID, EXP_ID_OTHER, MONEY, WINDOW_END, WINDOW_START
from splitlens.plans.common import IN_WINDOW, duck_variant
from splitlens.plans.registry import query
from splitlens.sources.tables import read_table, sql_read

N_DAYS = (WINDOW_END - WINDOW_START).days + 1
V_CUST = duck_variant("c_custkey")
V_ORD = duck_variant("o_custkey")
V_USER = duck_variant("user_id")


@query("sql_read", f"""
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n_orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS revenue
FROM orders GROUP BY o_orderstatus""")
def q_sql_read(spark, sf):
    return sql_read(spark, f"""
        SELECT o_orderstatus, count(*) AS n_orders,
               CAST(sum(CAST(o_totalprice AS {MONEY})) AS {MONEY}) AS revenue
        FROM {{orders}} GROUP BY o_orderstatus""", orders=read_table(spark, sf, "orders"))


_WINDOW_SQL = "o_orderdate >= :start AND o_orderdate < date_add(:end, 1)"


@query("param_query", f"""
SELECT CAST(o_orderdate AS DATE) AS order_date, CAST(count(*) AS BIGINT) AS n_orders
FROM orders WHERE {IN_WINDOW} GROUP BY 1""")
def q_param_query(spark, sf):
    return sql_read(spark, f"""
        SELECT CAST(o_orderdate AS DATE) AS order_date, count(*) AS n_orders
        FROM {{orders}} WHERE {_WINDOW_SQL} GROUP BY 1""",
                    args={"start": WINDOW_START, "end": WINDOW_END},
                    orders=read_table(spark, sf, "orders"))


@query("date_window", f"""
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS order_date
FROM orders WHERE {IN_WINDOW}""")
def q_date_window(spark, sf):
    o = read_table(spark, sf, "orders")
    return (o.filter(res.in_window("o_orderdate", WINDOW_START, WINDOW_END))
            .select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date")))


@query("experiment_filter", f"""
WITH a AS (
  SELECT '{EXP_ID}' AS experiment_id, c_custkey AS unit_id, {V_CUST} AS variant FROM customer
  UNION ALL
  SELECT '{EXP_ID_OTHER}', c_custkey, {duck_variant('c_custkey', EXP_ID_OTHER)} FROM customer)
SELECT * FROM a WHERE experiment_id = '{EXP_ID}'""")
def q_experiment_filter(spark, sf):
    c = read_table(spark, sf, "customer")
    table = asg.assignment_table(c, "c_custkey", [EXP_ID, EXP_ID_OTHER])
    return asg.experiment_filter(table, EXP_ID)


@query("format_4dp", """
SELECT l_returnflag, printf('%.4f', avg(l_discount)) AS avg_discount_txt
FROM lineitem GROUP BY l_returnflag""")
def q_format_4dp(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return (li.groupBy("l_returnflag")
            .agg(F.format_string("%.4f", F.avg("l_discount")).alias("avg_discount_txt")))


@query("ab_assignment", f"SELECT c_custkey AS unit_id, {V_CUST} AS variant FROM customer")
def q_ab_assignment(spark, sf):
    return asg.assign(read_table(spark, sf, "customer"), "c_custkey", EXP_ID) \
        .select("unit_id", "variant")


def _customer_orders(spark, sf):
    return read_table(spark, sf, "customer"), read_table(spark, sf, "orders")


_TOTAL_CTE = f"""
u AS (SELECT c_custkey AS unit_id, {V_CUST} AS variant FROM customer),
m AS (SELECT o_custkey AS unit_id, count(*) AS n_orders,
             sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue
      FROM orders WHERE {IN_WINDOW} GROUP BY o_custkey),
t AS (SELECT u.variant, count(*) AS units, count(m.unit_id) AS converted,
             coalesce(sum(m.n_orders), 0) AS orders, coalesce(sum(m.revenue), 0) AS revenue
      FROM u LEFT JOIN m ON u.unit_id = m.unit_id GROUP BY u.variant)"""


@query("ab_result_total", f"""
WITH {_TOTAL_CTE}
SELECT variant, CAST(units AS BIGINT) AS units, CAST(converted AS BIGINT) AS converted,
       CAST(orders AS BIGINT) AS orders, CAST(revenue AS DECIMAL(18,2)) AS revenue,
       round(converted / units, 4) AS cvr, round(orders / units, 4) AS orders_per_unit,
       round(CAST(revenue AS DOUBLE) / units, 4) AS revenue_per_unit
FROM t""")
def q_ab_result_total(spark, sf):
    c, o = _customer_orders(spark, sf)
    return res.result_total(c, o, EXP_ID, WINDOW_START, WINDOW_END)


@query("ab_cvr", f"""
WITH {_TOTAL_CTE}
SELECT variant, CAST(units AS BIGINT) AS units, CAST(converted AS BIGINT) AS converted,
       round(converted / units, 4) AS cvr
FROM t""")
def q_ab_cvr(spark, sf):
    c, o = _customer_orders(spark, sf)
    return res.cvr(c, o, EXP_ID, WINDOW_START, WINDOW_END)


@query("ab_result_daily", f"""
WITH spine AS (
  SELECT CAST(DATE '{WINDOW_START.isoformat()}' + CAST(i AS INTEGER) AS DATE) AS day, v.variant
  FROM range(0, {N_DAYS}) r(i), (SELECT unnest(['A', 'B']) AS variant) v),
u AS (SELECT {V_CUST} AS variant, count(*) AS units FROM customer GROUP BY 1),
m AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n,
             sum(CAST(o_totalprice AS DECIMAL(18,2))) AS rev
      FROM orders WHERE {IN_WINDOW} GROUP BY 1, 2),
dv AS (SELECT day, {V_ORD} AS variant, count(*) AS converted, sum(n) AS orders, sum(rev) AS revenue
       FROM m WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1, 2)
SELECT spine.day, spine.variant, CAST(u.units AS BIGINT) AS units,
       CAST(coalesce(dv.converted, 0) AS BIGINT) AS converted,
       CAST(coalesce(dv.orders, 0) AS BIGINT) AS orders,
       CAST(coalesce(dv.revenue, 0) AS DECIMAL(18,2)) AS revenue,
       round(coalesce(dv.converted, 0) / u.units, 4) AS cvr
FROM spine LEFT JOIN dv ON spine.day = dv.day AND spine.variant = dv.variant
LEFT JOIN u ON spine.variant = u.variant""")
def q_ab_result_daily(spark, sf):
    c, o = _customer_orders(spark, sf)
    return res.result_daily(spark, c, o, EXP_ID, WINDOW_START, WINDOW_END)


@query("ab_entry_cvr", f"""
WITH ud AS (
  SELECT user_id, CAST(ts AS DATE) AS d,
         min(ts) FILTER (WHERE event_type = 'view') AS e,
         max(ts) FILTER (WHERE event_type = 'purchase') AS g
  FROM events GROUP BY 1, 2)
SELECT {V_USER} AS variant, CAST(count(*) AS BIGINT) AS user_days,
       CAST(count(e) AS BIGINT) AS entered,
       CAST(count(*) FILTER (WHERE g > e) AS BIGINT) AS converted,
       round(count(e) / count(*), 4) AS entry_rate,
       round((count(*) FILTER (WHERE g > e)) / nullif(count(e), 0), 4) AS cvr_among_entrants
FROM ud WHERE user_id IS NOT NULL GROUP BY 1""")
def q_ab_entry_cvr(spark, sf):
    return res.entry_cvr(read_table(spark, sf, "events"), EXP_ID)


@query("ab_ctr", f"""
SELECT {V_USER} AS variant,
       CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS views,
       CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks,
       round((count(*) FILTER (WHERE event_type = 'click'))
             / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 4) AS ctr
FROM events WHERE user_id IS NOT NULL GROUP BY 1""")
def q_ab_ctr(spark, sf):
    return res.ctr(read_table(spark, sf, "events"), EXP_ID)


# a delivered assignment table with planted faults: every seventh unit twice, every eleventh also in the other group, every
# thirteenth without a group, and rows without a unit
_GIVEN_CTE = f"""
a AS (SELECT c_custkey AS unit_id, {V_CUST} AS variant FROM customer),
given AS (SELECT unit_id, CASE WHEN unit_id % 13 = 0 THEN NULL ELSE variant END AS variant FROM a
          UNION ALL SELECT unit_id, CASE WHEN unit_id % 13 = 0 THEN NULL ELSE variant END FROM a WHERE unit_id % 7 = 0
          UNION ALL SELECT unit_id, CASE WHEN variant = 'A' THEN 'B' ELSE 'A' END FROM a WHERE unit_id % 11 = 0
          UNION ALL SELECT NULL, variant FROM a WHERE unit_id % 17 = 0),
u AS (SELECT unit_id, count(*) AS n_rows, count(DISTINCT variant) AS n_variants, min(variant) AS lo, max(variant) AS hi FROM given GROUP BY unit_id),
st AS (SELECT *, CASE WHEN unit_id IS NULL THEN 'no unit' WHEN n_variants = 0 THEN 'no variant' WHEN n_variants > 1 THEN 'conflict'
                      WHEN n_rows > 1 THEN 'repeated' ELSE 'ok' END AS status FROM u)"""


def _given(spark, sf):
    a = asg.assign(read_table(spark, sf, "customer"), "c_custkey", EXP_ID)
    unit = F.col("unit_id")
    named = F.when(unit % 13 == 0, F.lit(None)).otherwise(F.col("variant"))
    other = F.when(F.col("variant") == "A", "B").otherwise("A")
    return (a.withColumn("variant", named)
            .unionByName(a.filter(unit % 7 == 0).withColumn("variant", named))
            .unionByName(a.filter(unit % 11 == 0).withColumn("variant", other))
            .unionByName(a.filter(unit % 17 == 0).withColumn("unit_id", F.lit(None).cast(a.schema["unit_id"].dataType))))


@query("ab_assignment_audit", f"""WITH {_GIVEN_CTE}
SELECT status, CAST(count(*) AS BIGINT) AS units, CAST(sum(n_rows) AS BIGINT) AS rows FROM st GROUP BY status""")
def q_ab_assignment_audit(spark, sf):
    return asg.assignment_audit(_given(spark, sf), EXP_ID)


@query("ab_assignment_problems", f"""WITH {_GIVEN_CTE}
SELECT unit_id, status AS problem, CAST(n_rows AS BIGINT) AS n_rows, CASE WHEN n_variants > 1 THEN lo || ',' || hi ELSE lo END AS variants
FROM st WHERE status <> 'ok'""")
def q_ab_assignment_problems(spark, sf):
    return asg.assignment_problems(_given(spark, sf), EXP_ID)


@query("ab_result_given", f"""WITH {_GIVEN_CTE},
o AS (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS rev FROM orders WHERE {IN_WINDOW} GROUP BY 1),
g AS (SELECT st.lo AS variant, count(*) AS units, count(n) AS converted, coalesce(sum(n), 0) AS orders, coalesce(sum(rev), 0) AS revenue
      FROM st JOIN customer ON st.unit_id = c_custkey LEFT JOIN o ON st.unit_id = o.o_custkey WHERE status IN ('ok', 'repeated') GROUP BY 1)
SELECT variant, CAST(units AS BIGINT) AS units, CAST(converted AS BIGINT) AS converted, CAST(orders AS BIGINT) AS orders,
       CAST(revenue AS DECIMAL(18,2)) AS revenue, round(converted / units, 4) AS cvr, round(orders / units, 4) AS orders_per_unit,
       round(CAST(revenue AS DOUBLE) / units, 4) AS revenue_per_unit FROM g""")
def q_ab_result_given(spark, sf):
    return res.result_total(read_table(spark, sf, "customer"), read_table(spark, sf, "orders"), EXP_ID, WINDOW_START, WINDOW_END,
                            assignments=asg.from_table(_given(spark, sf), EXP_ID))
