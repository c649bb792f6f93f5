"""Behaviour jobs on event logs: ordered funnels (N6, N7), weekday x hour heatmap (N8) and
next-action transitions inside sessions (N9).

None of these uses a window partitioned by user alone: a single very active user would put
all of their rows into one task.  Both jobs first collapse a user's events by second, then
work on what is left of each second.  There is one plan at every size.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlens.functions import ts_ntz
from splitlens.functions.numeric import safe_div
from splitlens.operators.assignment import variant_expr
from splitlens.pinned import FUNNEL_STEPS, RATE_DP, SESSION_GAP_SECONDS, VARIANTS

_EPOCH = dt.datetime(1970, 1, 1)


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp (independent of session zone)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", ts_ntz(_EPOCH), ts.cast("timestamp_ntz"))


# ---------------------------------------------------------------- N6 / N7 funnel
def funnel_times(events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS,
                 unit: Sequence[str] = ("user_id", "day")) -> DataFrame:
    """``unit..., times``: the times ``t_1 .. t_r`` of the steps a unit reached, ``t_k`` being the
    first time of step k strictly after ``t_{k-1}``.  Units without step 1 have an empty list;
    rows with a NULL user or time count nowhere.

    One scan and no join.  Events first collapse to ``(unit, second)``: the distinct times of each
    step (combined map-side; at most a million a second, the resolution of a timestamp), from which
    follows, for each number of steps done before, which steps that second adds.  A unit then folds
    its seconds in order: at most 86 400 for a user-day, however many rows it has.
    """
    unit = list(unit)
    ts_list = "array<timestamp_ntz>"
    matching = F.array_compact(F.array(*[F.when(F.col("event_type") == s, F.lit(k)) for k, s in enumerate(steps, 1)]))
    rows = (events.filter(F.col("event_type").isin(*steps))
            .select("user_id", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.explode(matching).alias("k"))
            .filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull()))
    second = F.floor(epoch_micros("ts") / F.lit(1_000_000))
    seconds = (rows.groupBy(*unit, second.alias("sec"))
               .agg(F.sort_array(F.collect_set(F.struct("ts", "k"))).alias("seen")))

    def added(done: int) -> Column:
        def take(acc, e):
            fits = (e["k"] == F.size(acc) + done + 1) & ((F.size(acc) == 0) | (e["ts"] > F.element_at(acc, -1)))
            return F.when(fits, F.concat(acc, F.array(e["ts"]))).otherwise(acc)
        return F.aggregate("seen", F.array().cast(ts_list), take)

    seconds = seconds.select(*unit, F.struct("sec", *[added(d).alias(f"from{d}") for d in range(len(steps))]).alias("s"))

    def fold(acc, s):
        more = F.array().cast(ts_list)
        for d in range(len(steps)):
            more = F.when(F.size(acc) == d, s[f"from{d}"]).otherwise(more)
        return F.concat(acc, more)

    return (seconds.groupBy(*unit).agg(F.sort_array(F.collect_list("s")).alias("s"))
            .select(*unit, F.aggregate("s", F.array().cast(ts_list), fold).alias("times")))


def funnel_reach(events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS,
                 unit: Sequence[str] = ("user_id", "day")) -> list[DataFrame]:
    """For each step k, the units that reached it: ``unit..., t_k``."""
    times = funnel_times(events, steps, unit)
    return [times.filter(F.size("times") >= k).select(*unit, F.element_at("times", k).alias(f"t{k}"))
            for k in range(1, len(steps) + 1)]


def funnel(events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS, exp_id: str | None = None,
           variants: Sequence[str] = VARIANTS, assignments: DataFrame | None = None) -> DataFrame:
    """``[variant,] step, step_no, user_days, step_rate, total_rate``.  With ``exp_id`` the
    user-days are split by variant (hash rule, or an explicit ``assignments`` table joined
    to the per-user-day times)."""
    group = ["variant"] if exp_id else []
    r = funnel_times(events, steps)
    if exp_id and assignments is None:
        r = r.withColumn("variant", variant_expr(F.col("user_id"), exp_id, variants))
    elif exp_id:
        r = r.join(assignments.select(F.col("unit_id").alias("user_id"), "variant"), "user_id")
    wide = r.groupBy(*group).agg(*[F.count_if(F.size("times") >= k).alias(f"n{k}") for k in range(1, len(steps) + 1)])
    counts = wide.select(*group, F.explode(F.array(*[
        F.struct(F.lit(s).alias("step"), F.lit(k).alias("step_no"), F.col(f"n{k}").alias("user_days"))
        for k, s in enumerate(steps, 1)])).alias("c")).select(*group, "c.*")
    # at most len(steps) rows per group: a window over them is trivially small
    if exp_id:
        # every variant x step, so a step nobody reached in a variant still shows 0
        spine = counts.sparkSession.range(1).select(F.explode(F.array(*[
            F.struct(F.lit(v).alias("variant"), F.lit(s).alias("step"), F.lit(k).alias("step_no"))
            for v in variants for k, s in enumerate(steps, 1)])).alias("c")).select("c.*")
        counts = spine.join(counts, ["variant", "step", "step_no"], "left")
    counts = counts.withColumn("user_days", F.coalesce("user_days", F.lit(0)).cast("bigint"))
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("step_no")
    prev = F.lag("user_days").over(w)
    first = F.first("user_days").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.select(
        *group, "step", F.col("step_no").cast("int").alias("step_no"), "user_days",
        F.round(F.when(F.col("step_no") == 1, F.lit(1.0)).otherwise(safe_div("user_days", prev)),
                RATE_DP).alias("step_rate"),
        F.round(safe_div("user_days", first), RATE_DP).alias("total_rate"))


# ---------------------------------------------------------------- N8 heatmap
def heatmap(events: DataFrame, ts: str = "ts") -> DataFrame:
    """``dow, h0 .. h23`` event counts; ``dow`` 0 = Monday.  One partial aggregate with 24
    conditional counts (no pivot pass)."""
    hour = F.hour(ts)
    return (events.select(F.weekday(ts).cast("int").alias("dow"), hour.alias("_h"))
            .groupBy("dow")
            .agg(*[F.count_if(F.col("_h") == h).alias(f"h{h}") for h in range(24)]))


# ---------------------------------------------------------------- N9 transitions
def transitions(events: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS,
                bucket_gaps: int = 4, id_block: int = 1 << 16) -> DataFrame:
    """``from_type, to_type, n``: consecutive events of a user at most ``gap_seconds`` apart
    (i.e. inside one session; a longer gap starts a new session).  Events without a user or time are nobody's
    session and do not count.

    Events in the order (ts, event_id) are folded in three steps, each a window that gives every
    event but its group's first a predecessor, and passes on only the first and last event of the group:

    1. groups ``(user, ts, event_id block)``: the events of one instant, ``id_block`` ids at a time, so even
       a flood with one time stamp is spread over tasks;
    2. groups ``(user, second)``: two rows for each instant and id block;
    3. groups ``(user, bucket)``, ``bucket_gaps * gap`` wide: two rows a second.  Those in the last ``gap``
       (and a second) of a bucket are also emitted as *carry* rows into the next one, so ``lag`` finds the
       predecessor of each second's first event.  One scan, no join, one plan at every size.
    """
    gap_us = gap_seconds * 1_000_000
    width_us = max(1_000_000, gap_us * bucket_gaps)
    us = epoch_micros("ts")
    order = ["ts", "event_id"]
    apart = F.timestamp_diff("MICROSECOND", F.col("_prev_ts"), F.col("ts")) <= F.lit(gap_us)
    columns = ["user_id", "event_id", "ts", "event_type"]
    rows = events.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select(*columns, F.lit(True).alias("_open"))
    pairs = []
    for group in (["ts", F.floor(F.col("event_id") / F.lit(id_block))], [F.floor(us / F.lit(1_000_000))]):
        # _open: the event has no predecessor yet (only a group's first keeps that)
        inside = Window.partitionBy("user_id", *group).orderBy(*order)
        rows = (rows.withColumn("from_type", F.lag("event_type").over(inside)).withColumn("_prev_ts", F.lag("ts").over(inside))
                .withColumn("_first", F.row_number().over(inside) == 1).withColumn("_last", ~F.lead(F.lit(True), 1, False).over(inside)))
        pairs.append(rows.filter(F.col("_open") & ~F.col("_first") & apart).select("from_type", "event_type"))
        rows = rows.filter(F.col("_first") | F.col("_last")).select(*columns, (F.col("_open") & F.col("_first")).alias("_open"))

    b = F.floor(us / F.lit(width_us))
    carry = us >= (b + 1) * F.lit(width_us) - F.lit(gap_us + 1_000_000)
    own = F.struct(b.alias("b"), F.lit(True).alias("own"))
    nxt = F.struct((b + 1).alias("b"), F.lit(False).alias("own"))
    edges = rows.withColumn("_k", F.explode(F.when(carry, F.array(own, nxt)).otherwise(F.array(own))))
    w = Window.partitionBy("user_id", "_k.b").orderBy(*order)
    pairs.append(edges.withColumn("from_type", F.lag("event_type").over(w)).withColumn("_prev_ts", F.lag("ts").over(w))
                 .filter(F.col("_k.own") & F.col("_open") & F.col("_prev_ts").isNotNull() & apart)
                 .select("from_type", "event_type"))
    return (pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).groupBy("from_type", F.col("event_type").alias("to_type"))
            .agg(F.count(F.lit(1)).alias("n")))
