"""Incremental daily group results (A3) over a stream of orders.

Two chained event-time aggregations, both finalised by the watermark (append mode):

1. ``(day window, variant, unit)`` -> orders, revenue: the per-unit-day pre-aggregate;
2. ``(day window, variant)`` -> converted units, orders, revenue.

A day is emitted once the watermark (max order time seen minus ``lateness``) passes its end;
orders arriving later than that are dropped as late data.  The denominators (units per
variant) come from the static population table through a stream-static join.  Unlike the
batch ``results.result_daily``, days without any order produce no row.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitlens.functions.numeric import safe_div
from splitlens.operators.assignment import variant_expr
from splitlens.operators.results import in_window, population_units
from splitlens.pinned import MONEY, RATE_DP, VARIANTS

ORDERS_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()),
    T.StructField("o_orderpriority", T.StringType()),
])


def orders_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of orders appearing under ``path`` (schema declared, no inference).  A cap on the files of a
    trigger is safe only for files delivered in event-time order: the watermark drops what comes later."""
    reader = spark.readStream.schema(ORDERS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def daily_results_stream(orders: DataFrame, customer: DataFrame, exp_id: str,
                         start: dt.date, end: dt.date, lateness: str = "2 days",
                         variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Streaming ``day, variant, units, converted, orders, revenue, cvr``."""
    # the window predicate is on the watermark column: a predicate on o_orderdate would be
    # pushed below the watermark, which would then never move past the experiment window
    o = (orders.withColumn("_ts", F.col("o_orderdate").cast("timestamp"))
         .withWatermark("_ts", lateness)
         .filter(in_window("_ts", start, end))
         .withColumn("variant", variant_expr(F.col("o_custkey"), exp_id, variants)))
    per_unit = (o.groupBy(F.window("_ts", "1 day").alias("w"), "variant", "o_custkey")
                .agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.col("o_totalprice").cast(MONEY)).alias("rev")))
    daily = (per_unit.groupBy(F.window(F.window_time("w"), "1 day").alias("d"), "variant")
             .agg(F.count(F.lit(1)).alias("converted"), F.sum("n").alias("orders"),
                  F.sum("rev").alias("revenue")))
    units = population_units(customer, "c_custkey", exp_id, variants)
    j = daily.join(F.broadcast(units), "variant")
    return j.select(F.to_date(F.col("d.start")).alias("day"), "variant",
                    F.col("units").cast("bigint").alias("units"),
                    F.col("converted").cast("bigint").alias("converted"),
                    F.col("orders").cast("bigint").alias("orders"),
                    F.col("revenue").cast(MONEY).alias("revenue"),
                    F.round(safe_div("converted", "units"), RATE_DP).alias("cvr"))


def run_daily_stream(spark: SparkSession, orders: DataFrame, customer: DataFrame, exp_id: str,
                     start: dt.date, end: dt.date, landing: str, checkpoint: str,
                     output: str, state_partitions: int | None = None) -> DataFrame:
    """Deliver ``orders`` as files in event-time order (one file per year) into ``landing``,
    run the streaming daily result over them to completion (``availableNow``) into a
    Parquet sink at ``output``, and return the sink as a batch DataFrame.

    A stateful query fixes its number of state partitions when it first starts (recorded
    in the checkpoint).  It is set from ``state_partitions``, by default the cluster's
    ``defaultParallelism``, for this query only; the session setting is restored after."""
    years = F.year("o_orderdate")
    bounds = orders.select(F.min(years).alias("lo"), F.max(years).alias("hi")).collect()[0]
    stream = daily_results_stream(orders_stream(spark, landing),
                                  customer, exp_id, start, end)
    if bounds["lo"] is None:              # no orders at all: no day to report
        return spark.createDataFrame([], stream.schema)
    for year in range(bounds["lo"], bounds["hi"] + 1):
        (orders.filter(years == year).write.mode("append").parquet(landing))
    n_state = state_partitions or max(1, spark.sparkContext.defaultParallelism)
    previous = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n_state))
    try:
        q = (stream.writeStream.format("parquet").option("path", output)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", previous)
    return spark.read.parquet(output)
