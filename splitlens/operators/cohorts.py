"""Cohort retention (N1, N2), churn (N3, N4 features) and periodic KPI reports.

Activity is first reduced to one row per ``(unit, period)`` by a partial aggregate; the
cohort of a unit is then a ``min`` over that unit's period rows, whose count is bounded by
the number of periods in the data (not by the unit's event volume).
"""

from __future__ import annotations

import datetime as dt
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitlens.functions import ts_ntz
from splitlens.functions.numeric import safe_div
from splitlens.pinned import MONEY, RATE_DP


def _cohorts(activity: DataFrame, unit: str, period: str) -> DataFrame:
    """Add ``cohort`` = first period of the unit to one-row-per-(unit, period) activity."""
    return activity.withColumn("cohort", F.min(period).over(Window.partitionBy(unit)))


def retention_daily(events: DataFrame, max_day: int = 7, unit: str = "user_id",
                    ts: str = "ts") -> DataFrame:
    """``cohort_day, day_n, cohort_size, active, rate`` for day_n = 0..max_day.

    Every cohort gets all ``max_day + 1`` rows (``active`` = 0 where nobody came back)."""
    act = events.select(unit, F.to_date(ts).alias("day")).distinct()
    c = _cohorts(act, unit, "day").withColumn("day_n", F.datediff("day", "cohort"))
    sizes = c.filter(F.col("day_n") == 0).groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_size"))
    active = (c.filter(F.col("day_n").between(0, max_day))
              .groupBy("cohort", "day_n").agg(F.count(F.lit(1)).alias("active")))
    spine = sizes.select("cohort", "cohort_size",
                         F.explode(F.sequence(F.lit(0), F.lit(max_day))).alias("day_n"))
    j = spine.join(active, ["cohort", "day_n"], "left")
    act_n = F.coalesce("active", F.lit(0))
    return j.select(F.col("cohort").cast("date").alias("cohort_day"),
                    F.col("day_n").cast("int").alias("day_n"),
                    F.col("cohort_size").cast("bigint").alias("cohort_size"),
                    act_n.cast("bigint").alias("active"),
                    F.round(safe_div(act_n, "cohort_size"), RATE_DP).alias("rate"))


def retention_monthly(orders: DataFrame, unit: str = "o_custkey",
                      ts: str = "o_orderdate") -> DataFrame:
    """``cohort_month, month_n, cohort_size, active, rate`` for every observed month offset."""
    month = F.trunc(F.to_date(ts), "month")
    act = orders.select(unit, month.alias("month")).distinct()
    c = _cohorts(act, unit, "month").withColumn(
        "month_n", (F.year("month") * 12 + F.month("month")) - (F.year("cohort") * 12 + F.month("cohort")))
    g = c.groupBy("cohort", "month_n").agg(F.count(F.lit(1)).alias("active"))
    size = F.max(F.when(F.col("month_n") == 0, F.col("active"))).over(Window.partitionBy("cohort"))
    g = g.withColumn("cohort_size", size)
    return g.select(F.col("cohort").cast("date").alias("cohort_month"),
                    F.col("month_n").cast("int").alias("month_n"),
                    F.col("cohort_size").cast("bigint").alias("cohort_size"),
                    F.col("active").cast("bigint").alias("active"),
                    F.round(safe_div("active", "cohort_size"), RATE_DP).alias("rate"))


def churn_by_segment(customer: DataFrame, orders: DataFrame, ref_date: dt.date,
                     horizon_days: int = 365, segment: str = "c_mktsegment") -> DataFrame:
    """``<segment>, customers, churned, churn_rate``: churned = no order in the
    ``horizon_days`` before ``ref_date``.  Customers without any order count as churned."""
    lo = ts_ntz(ref_date - dt.timedelta(days=horizon_days))
    hi = ts_ntz(ref_date)
    active = (orders.filter((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi))
              .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit(True).alias("_active")))
    j = customer.select("c_custkey", segment).join(active, "c_custkey", "left")
    g = j.groupBy(segment).agg(F.count(F.lit(1)).alias("customers"),
                               F.count_if(F.col("_active").isNull()).alias("churned"))
    return g.select(segment, F.col("customers").cast("bigint").alias("customers"),
                    F.col("churned").cast("bigint").alias("churned"),
                    F.round(safe_div("churned", "customers"), RATE_DP).alias("churn_rate"))


def churn_features(orders: DataFrame, cutoff: dt.date) -> DataFrame:
    """``c_custkey, recency_days, frequency, monetary, churned``.

    Features use orders strictly before ``cutoff``; the label is 1 when the customer has no
    order on or after it.  One partial aggregate over ``orders``, no join: both sides of the
    cutoff are conditional aggregates of the same pass, so no feature can see the label window.
    """
    c = ts_ntz(cutoff)
    before = F.col("o_orderdate") < c
    g = (orders.groupBy("o_custkey")
         .agg(F.max(F.when(before, F.col("o_orderdate"))).alias("_last"),
              F.count_if(before).alias("frequency"),
              F.sum(F.when(before, F.col("o_totalprice").cast(MONEY))).alias("monetary"),
              F.count_if(~before).alias("_after")))
    return (g.filter(F.col("frequency") > 0)
            .select(F.col("o_custkey").alias("c_custkey"),
                    F.datediff(F.lit(cutoff), F.to_date("_last")).cast("int").alias("recency_days"),
                    F.col("frequency").cast("bigint").alias("frequency"),
                    F.col("monetary").cast(MONEY).alias("monetary"),
                    F.when(F.col("_after") == 0, 1).otherwise(0).cast("int").alias("churned")))


def kpi(orders: DataFrame, grain: str) -> DataFrame:
    """``period, orders, customers, revenue, revenue_prev, revenue_growth`` per week or month.

    Distinct customers are counted from a ``(period, customer)`` pre-aggregate.  The period
    series is small (one row per week/month), so the ``lag`` over it runs in one task."""
    period = F.date_trunc(grain, F.col("o_orderdate")).cast("date")
    pc = (orders.select(period.alias("period"), "o_custkey",
                        F.col("o_totalprice").cast(MONEY).alias("_rev"))
          .groupBy("period", "o_custkey")
          .agg(F.count(F.lit(1)).alias("_n"), F.sum("_rev").alias("_rev")))
    g = pc.groupBy("period").agg(F.sum("_n").alias("orders"), F.count(F.lit(1)).alias("customers"),
                                 F.sum("_rev").alias("revenue"))
    prev = F.lag("revenue").over(Window.orderBy("period"))
    g = g.withColumn("revenue_prev", prev)
    return g.select("period", F.col("orders").cast("bigint").alias("orders"),
                    F.col("customers").cast("bigint").alias("customers"),
                    F.col("revenue").cast(MONEY).alias("revenue"),
                    F.col("revenue_prev").cast(MONEY).alias("revenue_prev"),
                    F.round(safe_div("revenue", "revenue_prev") - 1, RATE_DP).alias("revenue_growth"))
