"""Custom distributed operators checked against brute force on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from splitlens.operators import behaviour as B
from splitlens.operators import etl as E
from splitlens.operators import ranking as R


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_row_numbers_match_window(spark, seed):
    rnd = random.Random(seed)
    # one hot group with most of the rows, many ties in the value
    data = [(("hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 5)}"), rnd.randint(0, 9), i)
            for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v int, k long")
    got = R.row_numbers(df, ["v", "k"], ["g"], num_partitions=7)
    w = Window.partitionBy("g").orderBy("v", "k")
    exp = df.select("g", "v", "k", F.row_number().over(w).alias("_rn"),
                    F.count(F.lit(1)).over(Window.partitionBy("g")).alias("_n"))
    cols = ["g", "v", "k", "_rn", "_n"]
    assert _rows(got, cols) == _rows(exp, cols)


@pytest.mark.parametrize("bucket_gaps", [1, 3, 4])
def test_transitions_match_naive_lag(spark, bucket_gaps):
    base = dt.datetime(2024, 1, 1)
    rnd = random.Random(5)
    data, eid = [], 0
    for user in range(4):
        t = base
        for _ in range(300):
            # gaps around the 30-minute boundary, including exactly 1800 s
            t += dt.timedelta(seconds=rnd.choice([1, 60, 1799, 1800, 1801, 3599, 3600, 7200]))
            data.append((eid, t, user, rnd.choice(["view", "click", "purchase"])))
            eid += 1
    ev = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    got = B.transitions(ev, bucket_gaps=bucket_gaps)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    naive = (ev.withColumn("pt", F.lag("event_type").over(w)).withColumn("pts", F.lag("ts").over(w))
             .filter(F.col("pts").isNotNull()
                     & (F.timestamp_diff("SECOND", F.col("pts"), F.col("ts")) <= 1800))
             .groupBy(F.col("pt").alias("from_type"), F.col("event_type").alias("to_type"))
             .agg(F.count(F.lit(1)).alias("n")))
    cols = ["from_type", "to_type", "n"]
    assert _rows(got, cols) == _rows(naive, cols)


def test_keep_first_is_deterministic(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "x"), (1, 1, "a")],
                               "event_id long, _src int, payload string")
    got = E.keep_first(df, "event_id", ["_src"], ["event_id", "payload"])
    assert _rows(got, ["event_id", "payload"]) == [(1, "a"), (2, "x")]


def test_clean_tags(spark):
    raw = spark.createDataFrame([(1, "  VIEW ,, V0 ,"), (1, "Click,,view"), (2, " , ")],
                                "user_id long, tags_raw string")
    got = {r["user_id"]: r["tags"] for r in E.clean_tags(raw).collect()}
    assert got == {1: "click,v0,view"}


def test_keep_first_breaks_ties_by_payload(spark):
    rows = [(1, 0, "b"), (1, 0, "a"), (1, 0, "c")]
    for perm in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        df = spark.createDataFrame([rows[i] for i in perm], "event_id long, _src int, payload string")
        got = E.keep_first(df.repartition(3), "event_id", ["_src"], ["event_id", "payload"])
        assert len(got.collect()) == 1
        first = got.collect()[0]["payload"]
        if perm == [0, 1, 2]:
            expected = first
        assert first == expected


def test_hot_group_is_split_across_range_partitions(spark):
    """A group holding 90 % of the rows is spread over many tasks by the ranking operator."""
    rnd = random.Random(9)
    data = [("hot" if rnd.random() < 0.9 else f"g{rnd.randint(0, 20)}", rnd.random(), i)
            for i in range(20000)]
    df = spark.createDataFrame(data, "g string, v double, k long")
    numbered = R.numbered_partitions(df, ["v", "k"], ["g"], num_partitions=8)
    per_pid = {r["_pid"]: r["n"] for r in
               numbered.filter(F.col("g") == "hot").groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(per_pid) >= 6
    assert max(per_pid.values()) < 0.3 * sum(per_pid.values())


def test_transitions_of_a_burst_and_of_ties(spark):
    """Many events of one user inside single seconds, with equal times: same as one lag over the user."""
    base = dt.datetime(2024, 1, 1)
    rnd = random.Random(8)
    data = [(i, base + dt.timedelta(microseconds=rnd.choice([0, 500_000, 1_500_000, 1_801_000_000]) * (i // 400)), i % 10 // 9,
             rnd.choice(["view", "click", "purchase"])) for i in range(4000)]
    ev = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    exp = (ev.withColumn("from_type", F.lag("event_type").over(w)).withColumn("p", F.lag("ts").over(w))
           .filter(F.expr("timestampdiff(MICROSECOND, p, ts) <= 1800000000"))
           .groupBy("from_type", F.col("event_type").alias("to_type")).count().withColumnRenamed("count", "n"))
    cols = ["from_type", "to_type", "n"]
    assert _rows(B.transitions(ev), cols) == _rows(exp, cols)


@pytest.mark.parametrize("steps", [("view", "click", "purchase"), ("view", "view", "click"), ("click", "view", "click", "purchase")])
def test_funnel_times_match_a_walk_over_each_user_day(spark, steps):
    """A hot user-day, equal times, sub-second gaps, repeated rows, NULL users and times."""
    base = dt.datetime(2024, 1, 1, 22)
    rnd = random.Random(11)
    data = [(i, base + dt.timedelta(microseconds=rnd.randint(0, 40) * 250_000 + rnd.choice([0, 0, 7200_000_000])),
             rnd.choice([1, 1, 1, *range(2, 60)]), rnd.choice(["view", "click", "purchase", "other"])) for i in range(700)]
    data += data[:50] + [(9000, None, 1, "view"), (9001, base, None, "view")]
    ev = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    want = {}
    for _, ts, user, kind in sorted((d for d in data if d[1] is not None and d[2] is not None), key=lambda d: d[1]):
        want.setdefault((user, ts.date()), []).append((ts, kind))
    reached = {k: set() for k in range(1, len(steps) + 1)}
    for unit, seen in want.items():
        last = None
        for k, step in enumerate(steps, 1):
            later = [t for t, kind in seen if kind == step and (last is None or t > last)]
            if not later:
                break
            last = min(later)
            reached[k].add((*unit, last))
    for k, got in enumerate(B.funnel_reach(ev, steps), 1):
        assert {tuple(r) for r in got.collect()} == reached[k]


def test_transitions_leave_anonymous_events_out(spark):
    base = dt.datetime(2024, 1, 1)
    data = [(1, base, None, "view"), (2, base + dt.timedelta(seconds=5), None, "click"), (3, base, 7, "view"), (4, base + dt.timedelta(seconds=5), 7, "click")]
    ev = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    assert _rows(B.transitions(ev), ["from_type", "to_type", "n"]) == [("view", "click", 1)]


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_transitions_of_one_instant_in_blocks_of_ids(spark, block):
    """A flood of events with one time stamp is split by blocks of ids without losing a neighbour."""
    base = dt.datetime(2024, 1, 1)
    rnd = random.Random(6)
    data = [(i * 2, base + dt.timedelta(microseconds=rnd.choice([0, 0, 0, 1, 700_000])), i % 2, rnd.choice("abc")) for i in range(500)]
    ev = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    exp = (ev.withColumn("from_type", F.lag("event_type").over(w)).filter(F.col("from_type").isNotNull())
           .groupBy("from_type", F.col("event_type").alias("to_type")).count().withColumnRenamed("count", "n"))
    cols = ["from_type", "to_type", "n"]
    assert _rows(B.transitions(ev, id_block=block), cols) == _rows(exp, cols)
