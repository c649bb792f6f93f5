"""Exploratory profiles and segmentation.

Global quantities (min/max of a column) are scalar subqueries (``DataFrame.scalar()``):
Catalyst evaluates them once and inlines the value, with no join against a one-row frame.
Quantiles, tiles and ranks come from ``operators.selection``: positions found by counting, ranks from
the counts of distinct values; rows are neither sorted nor numbered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitlens.operators import selection as S
from splitlens.operators.behaviour import epoch_micros
from splitlens.pinned import MONEY, RATE_DP, STAT_DP
from splitlens.session import written


# ---------------------------------------------------------------- N10 profile
def _txt(c: str, dtype: T.DataType):
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return lambda e: e.cast("decimal(38,4)").cast("string")
    return lambda e: e.cast("string")


def column_profile(df: DataFrame, c: str, dtype: T.DataType) -> DataFrame:
    """One profile row for column ``c``.

    The column is first reduced to ``(value, count)`` -- a hash aggregate that reads only
    this column from the scan and combines map-side -- and every statistic is derived from
    that table: rows = sum of counts, distinct = non-null values, mean = weighted mean."""
    txt = _txt(c, dtype)
    numeric = isinstance(dtype, T.NumericType)
    vc = df.groupBy(c).agg(F.count(F.lit(1)).alias("_cnt"))
    v = F.col(c)
    mean = (F.round(F.sum(v.cast("double") * F.col("_cnt")) / F.sum(F.when(v.isNotNull(), F.col("_cnt"))),
                    RATE_DP) if numeric else F.lit(None).cast("double"))
    return vc.agg(F.lit(c).alias("column"),
                  F.sum("_cnt").cast("bigint").alias("rows"),
                  F.coalesce(F.sum(F.when(v.isNull(), F.col("_cnt"))), F.lit(0)).cast("bigint").alias("nulls"),
                  F.count(v).cast("bigint").alias("distinct"),
                  txt(F.min(v)).alias("min_txt"), txt(F.max(v)).alias("max_txt"),
                  mean.alias("mean"))


def eda_profile(df: DataFrame) -> DataFrame:
    """``column, rows, nulls, distinct, min_txt, max_txt, mean`` for every column (exact)."""
    parts = [column_profile(df, f.name, f.dataType) for f in df.schema.fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- N11 histogram / box
def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """``bucket, lo, hi, n``: equal-width bins over [min, max]; the max falls in the last bin;
    empty bins are kept with n = 0."""
    bounds = df.select(F.struct(F.min(col).cast("double").alias("lo"),
                                F.max(col).cast("double").alias("hi")).alias("b")).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.lit(bins), F.floor((F.col(col) - lo) / width) + 1)) \
        .otherwise(F.lit(1)).cast("int")
    counts = (df.filter(F.col(col).isNotNull()).select(b.alias("bucket"))
              .groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    spine = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bucket"))
    return (spine.join(counts, "bucket", "left")
            .select("bucket",
                    F.round(lo + (F.col("bucket") - 1) * width, RATE_DP).alias("lo"),
                    F.round(lo + F.col("bucket") * width, RATE_DP).alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def box_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """``<group>, q1, median, q3, lo_whisker, hi_whisker``: linearly interpolated quartiles
    (as ``percentile`` / ``quantile_cont``) and Tukey whiskers (most extreme values inside
    1.5 IQR of the box).  Rows without a group or value (NULL, NaN) do not count."""
    rows = df.select(group, value).filter(F.col(group).isNotNull() & S.finite(df, value))
    sizes = S.group_ranges(rows, [group], value)
    quartiles = (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    pos = {name: p * (F.col("n") - 1) for name, p in quartiles}
    wanted = F.array(*[F.struct(F.lit(f"{name}_{end}").alias("i"), (near(pos[name]) + 1).cast("long").alias("at"))
                       for name, _ in quartiles for end, near in (("lo", F.floor), ("hi", F.ceil))])
    wanted = sizes.select(group, "lo", "hi", F.explode(wanted).alias("w")).select(group, "lo", "hi", "w.i", "w.at")
    found = S.order_statistics(rows, [group], value, wanted)
    ends = found.groupBy(group).agg(*[F.max(F.when(F.col("i") == f"{name}_{end}", F.col(value))).alias(f"{name}_{end}")
                                      for name, _ in quartiles for end in ("lo", "hi")])
    box = ends.join(sizes.select(group, "n"), group).select(
        group, *[(F.col(f"{name}_lo") + (pos[name] - F.floor(pos[name])) * (F.col(f"{name}_hi") - F.col(f"{name}_lo"))).alias(name)
                 for name, _ in quartiles])
    box, _ = S.settled(box)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = rows.join(S.small(box, box.count()), group).groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(F.col(value) >= F.col("q1") - reach, F.col(value))).alias("lo_whisker"),
        F.max(F.when(F.col(value) <= F.col("q3") + reach, F.col(value))).alias("hi_whisker"))
    return near.select(group, *[F.round(c, RATE_DP).alias(c)
                                for c in ("q1", "median", "q3", "lo_whisker", "hi_whisker")])


# ---------------------------------------------------------------- N12 scatter / corr
def hash_sample(df: DataFrame, key: str, percent: int) -> DataFrame:
    """Deterministic sample: rows whose md5 bucket of ``key`` is below ``percent`` of 100."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("bigint")
    return df.filter(h % 100 < percent)


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.round(F.corr(F.col(x).cast("double"), F.col(y).cast("double")),
                            STAT_DP).alias("corr"),
                    F.count(F.lit(1)).cast("bigint").alias("n"))


# ---------------------------------------------------------------- N13 RFM
def tile_ends(per: DataFrame, key: str, metrics: Sequence[str], buckets: int) -> dict[str, list[tuple]]:
    """For each metric the (value, key) of the last row of every ``ntile(buckets)`` tile but the last, rows in the order
    (metric, key): ``buckets - 1`` pairs a metric.  The value at each cut comes from one selection over all metrics,
    the key from a second one over the rows that share a cut's value."""
    rows = S.long_form(per, key, metrics)
    q, rest = F.floor(F.col("n") / buckets), F.col("n") % buckets
    ends = F.array(*[F.struct(F.lit(i).alias("i"), (i * q + F.least(F.lit(i), rest)).cast("long").alias("at")) for i in range(1, buckets)])
    wanted = S.group_ranges(rows, ["metric"], "value").withColumn("w", F.explode(ends)).select("metric", "lo", "hi", "w.i", "w.at")
    cuts = S.order_statistics(rows, ["metric"], "value", wanted)
    tied = rows.join(F.broadcast(cuts.select("metric", "value").distinct()), ["metric", "value"])
    places = cuts.select("metric", "value", "i", (F.col("at") - F.col("before")).alias("at"))
    wanted = places.join(S.group_ranges(tied, ["metric", "value"], key).drop("n"), ["metric", "value"])
    last = S.order_statistics(tied, ["metric", "value"], key, wanted)
    out: dict[str, list[tuple]] = {m: [] for m in metrics}
    for r in last.select("metric", "i", "value", key).orderBy("metric", "i").collect():
        out[r["metric"]].append((r["value"], r[key]))
    return out


def rfm_segments(orders: DataFrame, buckets: int = 5) -> DataFrame:
    """``c_custkey, r, f, m, segment``: quintiles of last-order date (5 = most recent),
    order count and spend, each ``ntile`` over all customers with ties broken by key.
    Orders without a customer do not count; a NULL price counts as 0, a customer without any date as the earliest.

    The customers are never sorted: a tile is how many of the ``buckets - 1`` selected cuts a customer lies beyond."""
    per = (orders.filter(F.col("o_custkey").isNotNull()).groupBy(F.col("o_custkey").alias("c_custkey"))
           .agg(F.coalesce(epoch_micros(F.max("o_orderdate")), F.lit(-(1 << 52))).alias("r"), F.count(F.lit(1)).alias("f"),
                F.coalesce(F.sum(F.col("o_totalprice").cast(MONEY)) * 100, F.lit(0)).cast("bigint").alias("m")))
    per = written(per, "customers")
    cuts = tile_ends(per, "c_custkey", ["r", "f", "m"], buckets)
    tiles = [sum(((F.col(m) > v) | ((F.col(m) == v) & (F.col("c_custkey") > k))).cast("int") for v, k in cuts[m]) + F.lit(1)
             for m in ("r", "f", "m")]
    return (per.select("c_custkey", *[t.cast("int").alias(m) for m, t in zip(("r", "f", "m"), tiles)])
            .withColumn("segment", F.concat(*[F.col(m).cast("string") for m in ("r", "f", "m")])))


# ---------------------------------------------------------------- N19 user score
def user_score(per_user: DataFrame, metrics: Sequence[str], unit: str = "user_id") -> DataFrame:
    """``<unit>, score``: mean over ``metrics`` of ``percent_rank`` among all units (``unit`` is unique)."""
    x = S.percent_ranks(per_user.select(unit, *metrics), unit, metrics)
    score = sum(F.col(m) for m in metrics) / float(len(metrics))
    return x.select(unit, F.round(score, STAT_DP).alias("score"))
