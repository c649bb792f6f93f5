"""Per-group experiment results.

Shape of every plan here:

* the fact table is filtered to the half-open window (pushed into the Parquet scan),
* pre-aggregated to one row per unit (or unit-day) -- a partial + final hash aggregate,
  so a unit holding a huge share of rows collapses map-side before the shuffle,
* joined to the population (or to an explicit assignment table), one row per unit on both sides,
* tagged with its variant by expression and reduced to one row per variant (or day x variant).

Units of the population are the denominators and the only ones that count: facts of units that
are not in it, or of a NULL unit, belong to no group.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlens.functions import ts_ntz
from splitlens.functions.numeric import safe_div
from splitlens.operators.assignment import variant_expr
from splitlens.operators.metrics import REGISTRY
from splitlens.pinned import MONEY, RATE_DP, VARIANTS


def in_window(ts: Column | str, start: dt.date, end: dt.date) -> Column:
    """Whole-day, end-inclusive window as a half-open range: ``start <= ts < end + 1 day``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (ts >= ts_ntz(start)) & (ts < ts_ntz(end + dt.timedelta(days=1)))


def unit_metrics(orders: DataFrame, start: dt.date, end: dt.date,
                 by_day: bool = False) -> DataFrame:
    """One row per unit (and day): ``unit_id[, day], n_orders, revenue``; the two metrics
    are the registry's ``orders`` and ``revenue`` aggregates."""
    keys = [F.col("o_custkey").alias("unit_id")]
    if by_day:
        keys.append(F.to_date("o_orderdate").alias("day"))
    return (orders.filter(in_window("o_orderdate", start, end))
            .groupBy(*keys)
            .agg(REGISTRY["orders"]().alias("n_orders"), REGISTRY["revenue"]().alias("revenue")))


def _tag(df: DataFrame, exp_id: str, variants: Sequence[str],
         assignments: DataFrame | None) -> DataFrame:
    if assignments is None:
        return df.withColumn("variant", variant_expr(F.col("unit_id"), exp_id, variants))
    return df.join(assignments.select("unit_id", "variant"), "unit_id")


def _population(population: DataFrame, unit_col: str, exp_id: str, variants: Sequence[str],
                assignments: DataFrame | None) -> DataFrame:
    """``unit_id, variant`` of every unit that takes part; NULL units do not."""
    if assignments is not None:
        return assignments.select("unit_id", "variant").filter(F.col("unit_id").isNotNull())
    return (population.select(F.col(unit_col).alias("unit_id")).filter(F.col("unit_id").isNotNull())
            .withColumn("variant", variant_expr(F.col("unit_id"), exp_id, variants)))


def population_units(population: DataFrame, unit_col: str, exp_id: str,
                     variants: Sequence[str] = VARIANTS,
                     assignments: DataFrame | None = None,
                     extra_keys: Sequence[str] = ()) -> DataFrame:
    """``variant[, extra keys], units``: size of each assigned group."""
    if assignments is not None:
        base = assignments.select("unit_id", "variant")
        if extra_keys:
            base = base.join(population.select(F.col(unit_col).alias("unit_id"), *extra_keys),
                             "unit_id")
    else:
        base = population.select(F.col(unit_col).alias("unit_id"), *extra_keys)
        base = base.withColumn("variant", variant_expr(F.col("unit_id"), exp_id, variants))
    return (base.filter(F.col("unit_id").isNotNull()).groupBy("variant", *extra_keys)
            .agg(F.count(F.lit(1)).alias("units")))


def result_total(customer: DataFrame, orders: DataFrame, exp_id: str,
                 start: dt.date, end: dt.date, variants: Sequence[str] = VARIANTS,
                 assignments: DataFrame | None = None) -> DataFrame:
    """A2: ``variant, units, converted, orders, revenue, cvr, orders_per_unit, revenue_per_unit``."""
    units = _population(customer, "c_custkey", exp_id, variants, assignments)
    j = (units.join(unit_metrics(orders, start, end), "unit_id", "left").groupBy("variant")
         .agg(F.count(F.lit(1)).alias("units"), F.count("n_orders").alias("converted"),
              F.sum("n_orders").alias("orders"), F.sum("revenue").alias("revenue")))
    revenue = F.coalesce(F.col("revenue"), F.lit(0)).cast(MONEY)
    return j.select(
        "variant",
        F.col("units").cast("bigint").alias("units"),
        F.coalesce("converted", F.lit(0)).cast("bigint").alias("converted"),
        F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"),
        revenue.alias("revenue"),
        F.round(safe_div(F.coalesce("converted", F.lit(0)), "units"), RATE_DP).alias("cvr"),
        F.round(safe_div(F.coalesce("orders", F.lit(0)), "units"), RATE_DP).alias("orders_per_unit"),
        F.round(safe_div(revenue, "units"), RATE_DP).alias("revenue_per_unit"),
    )


def day_spine(spark: SparkSession, start: dt.date, end: dt.date,
              variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Every ``day x variant`` of the window; size fixed by the parameters."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day")
    ).select("day", F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"))


def result_daily(spark: SparkSession, customer: DataFrame, orders: DataFrame, exp_id: str,
                 start: dt.date, end: dt.date, variants: Sequence[str] = VARIANTS,
                 assignments: DataFrame | None = None) -> DataFrame:
    """A3: ``day, variant, units, converted, orders, revenue, cvr`` on a full spine.

    ``converted`` counts units with an order that day, so it does not add up to the total.
    """
    units = population_units(customer, "c_custkey", exp_id, variants, assignments)
    daily = (unit_metrics(orders, start, end, by_day=True)
             .join(_population(customer, "c_custkey", exp_id, variants, assignments), "unit_id")
             .groupBy("day", "variant")
             .agg(F.count(F.lit(1)).alias("converted"),
                  F.sum("n_orders").alias("orders"),
                  F.sum("revenue").alias("revenue")))
    spine = F.broadcast(day_spine(spark, start, end, variants))
    j = spine.join(daily, ["day", "variant"], "left").join(F.broadcast(units), "variant", "left")
    conv = F.coalesce("converted", F.lit(0))
    return j.select(
        F.col("day").cast("date").alias("day"),
        "variant",
        F.coalesce("units", F.lit(0)).cast("bigint").alias("units"),
        conv.cast("bigint").alias("converted"),
        F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"),
        F.coalesce("revenue", F.lit(0)).cast(MONEY).alias("revenue"),
        F.round(safe_div(conv, "units"), RATE_DP).alias("cvr"),
    )


def cvr(customer: DataFrame, orders: DataFrame, exp_id: str, start: dt.date, end: dt.date,
        variants: Sequence[str] = VARIANTS, assignments: DataFrame | None = None) -> DataFrame:
    """A4: ``variant, units, converted, cvr``."""
    return result_total(customer, orders, exp_id, start, end, variants, assignments) \
        .select("variant", "units", "converted", "cvr")


def user_day_entry(events: DataFrame, entry_type: str = "view",
                   goal_type: str = "purchase") -> DataFrame:
    """One row per user-day: first entry time and last goal time (partial aggregate)."""
    return (events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_type")
            .groupBy("user_id", "day")
            .agg(F.min(F.when(F.col("event_type") == entry_type, F.col("ts"))).alias("entry_ts"),
                 F.max(F.when(F.col("event_type") == goal_type, F.col("ts"))).alias("goal_ts")))


def entry_cvr(events: DataFrame, exp_id: str, variants: Sequence[str] = VARIANTS,
              entry_type: str = "view", goal_type: str = "purchase",
              assignments: DataFrame | None = None) -> DataFrame:
    """A5: ``variant, user_days, entered, converted, entry_rate, cvr_among_entrants``.

    A user-day *enters* with an ``entry_type`` event and *converts* with a ``goal_type``
    event later the same day.
    """
    ud = user_day_entry(events.filter(F.col("user_id").isNotNull()), entry_type, goal_type).withColumnRenamed("user_id", "unit_id")
    g = (_tag(ud, exp_id, variants, assignments)
         .groupBy("variant")
         .agg(F.count(F.lit(1)).alias("user_days"),
              F.count_if(F.col("entry_ts").isNotNull()).alias("entered"),
              F.count_if(F.col("goal_ts") > F.col("entry_ts")).alias("converted")))
    return g.select(
        "variant",
        F.col("user_days").cast("bigint").alias("user_days"),
        F.col("entered").cast("bigint").alias("entered"),
        F.col("converted").cast("bigint").alias("converted"),
        F.round(safe_div("entered", "user_days"), RATE_DP).alias("entry_rate"),
        F.round(safe_div("converted", "entered"), RATE_DP).alias("cvr_among_entrants"),
    )


def ctr(events: DataFrame, exp_id: str, variants: Sequence[str] = VARIANTS,
        view_type: str = "view", click_type: str = "click",
        assignments: DataFrame | None = None) -> DataFrame:
    """``variant, views, clicks, ctr``; a plain ratio (clicks may exceed views).

    With the hash rule every event is tagged where it is scanned and the aggregate collapses
    to one row per variant map-side.  An explicit assignment table is joined to per-user
    counts instead of to the events."""
    events = events.filter(F.col("user_id").isNotNull())
    is_view = F.col("event_type") == view_type
    is_click = F.col("event_type") == click_type
    if assignments is None:
        g = (events.select(variant_expr(F.col("user_id"), exp_id, variants).alias("variant"),
                           "event_type")
             .groupBy("variant")
             .agg(F.count_if(is_view).alias("views"), F.count_if(is_click).alias("clicks")))
    else:
        per_user = (events.groupBy(F.col("user_id").alias("unit_id"))
                    .agg(F.count_if(is_view).alias("v"), F.count_if(is_click).alias("c")))
        g = (_tag(per_user, exp_id, variants, assignments).groupBy("variant")
             .agg(F.sum("v").alias("views"), F.sum("c").alias("clicks")))
    return g.select("variant", F.col("views").cast("bigint").alias("views"),
                    F.col("clicks").cast("bigint").alias("clicks"),
                    F.round(safe_div("clicks", "views"), RATE_DP).alias("ctr"))


def segment_result(customer: DataFrame, orders: DataFrame, exp_id: str, start: dt.date,
                   end: dt.date, segment_col: str = "c_mktsegment",
                   variants: Sequence[str] = VARIANTS,
                   assignments: DataFrame | None = None) -> DataFrame:
    """``segment, variant, units, converted`` for every segment x variant.

    The segment lives on the population table, so the population is left-joined to the
    converted units (one row per unit on both sides; no fact rows take part) and both
    counts come from one aggregate over that join -- a single scan of the population."""
    pop = (customer.select(F.col("c_custkey").alias("unit_id"), F.col(segment_col).alias("segment"))
           .filter(F.col("unit_id").isNotNull()))
    conv = unit_metrics(orders, start, end).select("unit_id", F.lit(True).alias("_conv"))
    j = pop.join(conv, "unit_id", "left")
    j = (j.withColumn("variant", variant_expr(F.col("unit_id"), exp_id, variants))
         if assignments is None else j.join(assignments.select("unit_id", "variant"), "unit_id"))
    return (j.groupBy("segment", "variant")
            .agg(F.count(F.lit(1)).cast("bigint").alias("units"),
                 F.count("_conv").cast("bigint").alias("converted")))
