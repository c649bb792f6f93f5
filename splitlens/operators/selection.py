"""Exact order statistics and ranks without sorting the rows.

``order_statistics`` finds the values at given positions of each group by counting.  Every wanted
position starts in the range [min, max] of its group; a pass counts the rows of each such range in
``BINS`` equal steps (a partial aggregate on the map side, so a hot value or group is one row per
task and bin), keeps only the step that holds the position, and goes on with that step's own
smallest and largest value.  A range whose two ends are equal is done.  Rows outside the ranges drop
out of each pass; nothing is sorted, numbered or written but the state of the wanted positions.

``running_counts`` gives the distinct values of a column the number of rows below them.  Values are
dealt into ranges at approximate quantiles, which decide the balance of the work and not the result:
a window inside each range, plus the total of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitlens.session import drop_written, written

BINS = 4096
SMALL_STATE = 100_000     # ranges up to which they are sent to every task instead of shuffling the rows
FEW_STATE = 5_000         # rows of state up to which it is kept by the driver instead of a written table
RANGES = 200              # value ranges of running_counts


def finite(df: DataFrame, value: str) -> Column:
    """Rows with a value: not NULL, and for floating types not NaN."""
    ok = F.col(value).isNotNull()
    floating = isinstance(df.schema[value].dataType, (T.FloatType, T.DoubleType))
    return ok & ~F.isnan(value) if floating else ok


def group_ranges(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """``groups, n, lo, hi``: rows, smallest and largest value of each group."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast when it has few rows (counted), else as it is."""
    return F.broadcast(df) if rows <= SMALL_STATE else df


def local(df: DataFrame) -> DataFrame:
    """The rows of ``df``, known to be few, held by the driver."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def settled(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` evaluated once: held by the driver when it has at most FEW_STATE rows (counted), else a written table."""
    rows = df.limit(FEW_STATE + 1).collect()
    if len(rows) <= FEW_STATE:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return written(df, "selection"), False


def order_statistics(df: DataFrame, groups: Sequence[str], value: str, wanted: DataFrame, bins: int = BINS) -> DataFrame:
    """``groups, i, at, value, before`` for each row ``groups, i, at, lo, hi`` of ``wanted``: the value at position ``at``
    (from 1) of the group in ascending order, and how many rows of the group are smaller.

    ``lo`` and ``hi`` are the group's smallest and largest value (``group_ranges``).  Values are finite numbers."""
    rows = df.select(*groups, F.col(value).alias("_v"))
    state, few = settled(wanted.select(*groups, "i", "at", "lo", "hi", F.lit(0).cast("long").alias("before")))
    while True:
        ranges = state.filter("lo <> hi").select(*groups, "lo", "hi").distinct()
        open_ranges = ranges.count()
        if not open_ranges:
            return state.select(*groups, "i", "at", F.col("lo").alias(value), "before")
        step = ((F.col("_v") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double") * F.lit(float(bins)))
        inside = (rows.join(small(ranges, open_ranges), list(groups)).filter("_v BETWEEN lo AND hi")
                  .withColumn("_bin", F.least(F.floor(step), F.lit(bins - 1))))
        counted = inside.groupBy(*groups, "lo", "hi", "_bin").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        earlier = Window.partitionBy(*groups, "lo", "hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_less", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        rank = F.col("at") - F.col("before")
        closer = (state.filter("lo <> hi").join(counted, [*groups, "lo", "hi"])
                  .filter((rank > F.col("_less")) & (rank <= F.col("_less") + F.col("_n")))
                  .select(*groups, "i", "at", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("before") + F.col("_less")).alias("before")))
        previous, state = state, closer.unionByName(state.filter("lo = hi"))
        if few:
            state = local(state)
        else:
            state = written(state, "selection")
            drop_written(previous)


def running_counts(values: DataFrame, group: str, value: str, count: str, out: str, ranges: int = RANGES) -> DataFrame:
    """Add ``out``: the sum of ``count`` over the rows of the same ``group`` with a smaller ``value`` (NULL is the smallest).

    ``values`` holds each (group, value) once; ``group`` is one of a few names (metrics).  Only the cut points between
    value ranges, ``ranges`` for each name, are collected."""
    cuts = (values.filter(F.col(value).isNotNull()).groupBy(group)
            .agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("cuts")).collect())
    place = F.lit(0)
    kind = values.schema[value].dataType
    for name, points in cuts:
        fixed = F.array(*[F.lit(p).cast(kind) for p in sorted(set(points))])
        above = F.size(F.filter(fixed, lambda c: c < F.col(value))) + 1  # noqa: B023  built in this round
        place = F.when((F.col(group) == F.lit(name)) & F.col(value).isNotNull(), above).otherwise(place)
    dealt = values.withColumn("_range", place)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy(group, "_range").agg(F.sum(count).alias("_total"))
               .select(group, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy(group, "_range").orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("_inside", F.coalesce(F.sum(count).over(inside), F.lit(0)))
            .join(F.broadcast(offsets), [group, "_range"])
            .withColumn(out, F.col("_offset") + F.col("_inside")).drop("_range", "_inside", "_offset"))


def long_form(df: DataFrame, unit: str | None, metrics: Sequence[str], *others: str) -> DataFrame:
    """``[unit,] others, metric, value``: one row for each metric, values in their common type."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    wide = [F.col(m).cast(_common(df, metrics)).alias(m) for m in metrics]
    keep = [c for c in (unit, *others) if c]
    return df.select(*keep, *wide).select(*keep, F.explode(pairs).alias("_m")).select(*keep, "_m.metric", "_m.value")


def _common(df: DataFrame, metrics: Sequence[str]) -> T.DataType:
    return df.select(F.coalesce(*metrics).alias("v")).schema["v"].dataType


def percent_ranks(df: DataFrame, unit: str, metrics: Sequence[str]) -> DataFrame:
    """``unit`` and for each metric SQL's ``percent_rank() OVER (ORDER BY metric)`` under the metric's name (ties share the
    smallest rank, NULL comes first; a lone row has 0).  All metrics share one shuffle; a tied value is counted as one row,
    and its units meet its rank in a join whose hot side adaptive execution can split."""
    rows = long_form(df, unit, metrics)
    counted = rows.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_counts(counted, "metric", "value", "_n", "_below")
    sizes = F.broadcast(counted.groupBy("metric").agg(F.sum("_n").alias("_size")))
    ranks = (ranks.join(sizes, "metric")
             .select(F.col("metric").alias("_rm"), F.col("value").alias("_rv"),
                     F.when(F.col("_size") <= 1, 0.0).otherwise(F.col("_below").cast("double") / (F.col("_size") - 1)).alias("_pr")))
    met = rows.join(ranks, (F.col("metric") == F.col("_rm")) & F.col("value").eqNullSafe(F.col("_rv")))
    return met.groupBy(unit).agg(*[F.max(F.when(F.col("metric") == m, F.col("_pr"))).alias(m) for m in metrics])


def rank_auc(df: DataFrame, label: str, scores: Sequence[str]) -> DataFrame:
    """``score, positives, negatives, auc`` of each column of ``scores`` against the 0/1 ``label``: the chance that a positive
    row has a larger score than a negative one, ties counting half.  Rows without label or score do not count.

    Positives and negatives are added up per distinct score first, so ties cost one row; NULL without both classes."""
    rows = long_form(df.filter(F.col(label).isNotNull()), None, scores, label).filter(F.col("value").isNotNull())
    counted = rows.groupBy("metric", "value").agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    ranked = running_counts(counted, "metric", "value", "_neg", "_below")
    twice = F.col("_pos").cast("decimal(19,0)") * (2 * F.col("_below") + F.col("_neg")).cast("decimal(19,0)")
    return (ranked.groupBy(F.col("metric").alias("score"))
            .agg(F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"), F.sum(twice).cast("double").alias("_twice"))
            .select("score", "positives", "negatives",
                    F.try_divide(F.col("_twice"), 2.0 * F.col("positives") * F.col("negatives")).alias("auc")))
