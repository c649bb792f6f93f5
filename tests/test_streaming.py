"""The streaming daily result equals the batch one on every day that has orders."""


from pyspark.sql import functions as F

from splitlens.operators import results as res
from splitlens.pinned import EXP_ID, WINDOW_END, WINDOW_START
from splitlens.session import shared_dir
from splitlens.sources.tables import read_table
from splitlens.streaming import daily_results_stream, orders_stream
from tests.conftest import SF01


def test_stream_matches_batch(spark):
    orders = read_table(spark, SF01, "orders")
    customer = read_table(spark, SF01, "customer")
    src = shared_dir(spark, "orders-stream")
    # deliver the table as files in event-time order, one file per year
    for year in range(1995, 2002):
        (orders.filter(F.year("o_orderdate") == year).coalesce(1)
         .write.mode("append").parquet(src))
    stream = daily_results_stream(orders_stream(spark, src), customer, EXP_ID,
                                  WINDOW_START, WINDOW_END)
    q = (stream.writeStream.format("memory").queryName("daily_stream")
         .option("checkpointLocation", shared_dir(spark, "daily-stream-ckpt"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {(r["day"], r["variant"]): r.asDict() for r in spark.table("daily_stream").collect()}
    batch = res.result_daily(spark, customer, orders, EXP_ID, WINDOW_START, WINDOW_END)
    want = {(r["day"], r["variant"]): r.asDict() for r in batch.filter("converted > 0").collect()}
    missing = sorted(set(want) - set(got))
    assert not missing, missing
    assert got == want
    assert len(want) > 0


def test_late_orders_after_the_watermark_are_dropped(spark):
    """Once the watermark has passed the experiment window, orders dated inside it that
    arrive later change nothing: the emitted days are final."""
    orders = read_table(spark, SF01, "orders")
    customer = read_table(spark, SF01, "customer")
    src, ckpt, out = (shared_dir(spark, n) for n in ("late-src", "late-ckpt", "late-out"))
    for year in range(1995, 2002):
        orders.filter(F.year("o_orderdate") == year).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = daily_results_stream(orders_stream(spark, src, 1000), customer, EXP_ID,
                                      WINDOW_START, WINDOW_END)
        q = (stream.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination(300)
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    first = run()
    late = (orders.filter((F.col("o_orderdate") >= F.lit("1997-05-20").cast("timestamp_ntz"))
                          & (F.col("o_orderdate") < F.lit("1997-05-21").cast("timestamp_ntz")))
            .withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))
    late.coalesce(1).write.mode("append").parquet(src)
    assert late.count() > 0
    assert run() == first
