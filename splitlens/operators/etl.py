"""Log cleaning and merging (N14-N16) and the per-user summary.

De-duplication keeps one row per id with ``min_by`` in a hash aggregate rather than a
``row_number`` window: the aggregate combines map-side, so an id repeated millions of times
collapses before the shuffle instead of landing in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.pinned import MONEY

# The event types a clean log may contain.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_COLS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def keep_first(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per ``key``: the row with the smallest ``order`` tuple.  A hash of the payload
    is the last sort key, so rows tied on ``order`` resolve the same way on every run."""
    rest = [c for c in cols if c != key]
    payload = F.struct(*[F.col(c) for c in rest])
    rank = F.struct(*[F.col(c) for c in order], F.xxhash64(*[F.col(c) for c in rest]))
    ranked = df.groupBy(key).agg(F.min_by(payload, rank).alias("_row"))
    return ranked.select(key, *[F.col(f"_row.{c}").alias(c) for c in cols if c != key])


# ---------------------------------------------------------------- N14 clean logs
def dirty_copies(events: DataFrame) -> DataFrame:
    """A raw log derived from ``events`` by expressions: every row as delivered (source 0),
    a copy with padded upper-case types (source 1), a copy without a user (source 2) and a
    copy with a negative value (source 3).  Cleaning must give back exactly ``events``."""
    base = events.select(*EVENT_COLS)
    padded = base.withColumn("event_type", F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))
    no_user = base.withColumn("user_id", F.lit(None).cast("bigint"))
    negative = base.withColumn("value", -F.col("value") - 1)
    out = None
    for i, part in enumerate((base, padded, no_user, negative)):
        part = part.withColumn("_src", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def clean_logs(raw: DataFrame, allowed: Sequence[str] = EVENT_TYPES,
               priority: str = "_src") -> DataFrame:
    """Normalise text, drop rows with missing keys or invalid values, keep the first
    delivery of each ``event_id``."""
    norm = raw.withColumn("event_type", F.lower(F.trim("event_type")))
    valid = norm.filter(F.col("event_id").isNotNull() & F.col("user_id").isNotNull()
                        & F.col("ts").isNotNull() & F.col("event_type").isin(*allowed)
                        & (F.col("value").isNull() | (F.col("value") >= 0)))
    return keep_first(valid, "event_id", [priority, "ts"], EVENT_COLS)


# ---------------------------------------------------------------- N16 merge logs
def overlapping_exports(events: DataFrame, split_hour_a: int = 16,
                        split_hour_b: int = 8) -> tuple[DataFrame, DataFrame]:
    """Two exports of the same log with overlapping coverage (hours < 16 and hours >= 8);
    together they cover every row, the overlap is delivered twice."""
    base = events.select(*EVENT_COLS)
    a = base.filter(F.hour("ts") < split_hour_a).withColumn("_src", F.lit(0))
    b = base.filter(F.hour("ts") >= split_hour_b).withColumn("_src", F.lit(1))
    return a, b


def merge_events(*logs: DataFrame, priority: str = "_src") -> DataFrame:
    """Union by column name and keep one row per ``event_id`` (earliest source first)."""
    u = logs[0]
    for other in logs[1:]:
        u = u.unionByName(other, allowMissingColumns=True)
    return keep_first(u, "event_id", [priority], EVENT_COLS)


# ---------------------------------------------------------------- N15 clean tags
def messy_tags(events: DataFrame) -> DataFrame:
    """Per event a joined tag string with stray spaces, case and empty items, e.g.
    ``'  VIEW ,, V0 ,'`` (event type and a value band)."""
    band = F.floor(F.col("value") / 100).cast("bigint").cast("string")
    return events.select("user_id", F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ,, V"),
                                             band, F.lit(" ,")).alias("tags_raw"))


def clean_tags(raw: DataFrame, unit: str = "user_id", col: str = "tags_raw") -> DataFrame:
    """``unit, tags``: split, trim, lower-case, drop empty, de-duplicate, sort, comma-join.

    Distinct ``(unit, tag)`` pairs are formed first (partial aggregate), so the per-unit
    collection holds at most the tag vocabulary, whatever the unit's row count."""
    items = F.filter(F.transform(F.split(F.col(col), ","), lambda t: F.lower(F.trim(t))),
                     lambda t: t != "")
    pairs = raw.select(unit, F.explode(items).alias("tag")).distinct()
    return (pairs.groupBy(unit)
            .agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags")))


# ---------------------------------------------------------------- N17 user summary
def user_summary(events: DataFrame) -> DataFrame:
    """``user_id, events, views, clicks, purchases, total_value, first_ts, last_ts``."""
    t = F.col("event_type")
    return (events.groupBy("user_id")
            .agg(F.count(F.lit(1)).cast("bigint").alias("events"),
                 F.count_if(t == "view").cast("bigint").alias("views"),
                 F.count_if(t == "click").cast("bigint").alias("clicks"),
                 F.count_if(t == "purchase").cast("bigint").alias("purchases"),
                 F.sum(F.col("value").cast(MONEY)).cast(MONEY).alias("total_value"),
                 F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
