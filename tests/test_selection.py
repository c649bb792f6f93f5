"""Order statistics, tiles, ranks and the AUC by counting, against sorting the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from splitlens.operators import profile as P
from splitlens.operators import selection as S


def _rows(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("bins, few", [(5, 5000), (64, 3), (4096, 5000)])
def test_order_statistics_equal_sorting(spark, monkeypatch, bins, few):
    monkeypatch.setattr(S, "FEW_STATE", few)      # state by the driver, or in written tables
    rnd = random.Random(bins)
    data = [("hot" if rnd.random() < 0.8 else f"g{rnd.randint(0, 4)}", rnd.choice([7.25, rnd.gauss(0, 1), 10 ** rnd.uniform(-9, 9)])) for _ in range(3000)]
    df = spark.createDataFrame(data + [("one", 3.0), ("same", 2.0), ("same", 2.0)], "g string, v double").repartition(5)
    sizes = S.group_ranges(df, ["g"], "v")
    wanted = sizes.select("g", "lo", "hi", F.posexplode(F.transform(F.array(F.lit(0.0), F.lit(0.1), F.lit(0.5), F.lit(0.93), F.lit(1.0)),
                                                                    lambda q: (F.floor(q * (F.col("n") - 1)) + 1).cast("long"))).alias("i", "at"))
    groups = {}
    for g, v in [(r["g"], r["v"]) for r in df.collect()]:
        groups.setdefault(g, []).append(v)
    got = S.order_statistics(df, ["g"], "v", wanted, bins).collect()
    assert len(got) == 5 * len(groups)
    for r in got:
        values = sorted(groups[r["g"]])
        assert r["v"] == values[r["at"] - 1] and r["before"] == sum(x < r["v"] for x in values)


def test_box_stats_of_hot_tied_and_odd_groups(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["a"] * 9 + ["b"]), 5.0 if rnd.random() < 0.9 else rnd.uniform(-50, 80), i) for i in range(2000)]
    data += [("c", 1.0, 1), ("d", None, 1), (None, 4.0, 1), ("e", float("nan"), 1), ("e", 2.0, 2), ("e", 4.0, 3)]
    got = {r["g"]: tuple(r)[1:] for r in P.box_stats(spark.createDataFrame(data, "g string, v double, k int"), "v", "g").collect()}
    assert set(got) == {"a", "b", "c", "e"}
    for g in got:
        v = np.array([x for h, x, _ in data if h == g and x is not None and x == x])
        q1, median, q3 = np.quantile(v, [.25, .5, .75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1))].min(), v[(v <= q3 + 1.5 * (q3 - q1))].max()
        assert got[g] == pytest.approx((q1, median, q3, *inside), abs=1e-4)


@pytest.mark.parametrize("n, buckets", [(1003, 5), (3, 5), (1, 4), (200, 7)])
def test_tiles_equal_ntile(spark, n, buckets):
    rnd = random.Random(n)
    data = [(i * 3 - 50, rnd.choice([1, 1, 1, 2, 9]), rnd.randint(0, 10 ** 6), rnd.choice([0, 4])) for i in range(n)]
    df = spark.createDataFrame(data, "k long, a long, b long, c long").repartition(3)
    cuts = P.tile_ends(df, "k", ["a", "b", "c"], buckets)
    for m in "abc":
        want = df.select("k", m, F.ntile(buckets).over(Window.orderBy(m, "k")).alias("t")).collect()
        assert [r["t"] for r in want] == [1 + sum((r[m], r["k"]) > cut for cut in cuts[m]) for r in want]


def test_rfm_of_customers_without_dates_or_prices(spark):
    rows = [(i % 9 if i % 10 else None, None if i % 9 == 4 else f"199{i % 8}-01-0{1 + i % 5} 00:00:00", None if i % 9 == 5 else float(i)) for i in range(60)]
    orders = spark.createDataFrame(rows, "o_custkey long, d string, o_totalprice double").withColumn("o_orderdate", F.col("d").cast("timestamp_ntz"))
    got = P.rfm_segments(orders, 3)
    assert got.count() == 9 and {r["r"] for r in got.filter("c_custkey = 4").collect()} == {1}
    assert P.rfm_segments(orders.limit(0)).count() == 0


def test_percent_ranks_when_nearly_all_tie(spark):
    rnd = random.Random(4)
    data = [(i, None if rnd.random() < 0.02 else (7 if rnd.random() < 0.9 else rnd.randint(0, 20)), rnd.randint(0, 3000), 1.5) for i in range(3000)]
    df = spark.createDataFrame(data, "k long, a int, b long, c double").repartition(6)
    got = S.percent_ranks(df, "k", ["a", "b", "c"])
    want = df.select("k", *[F.percent_rank().over(Window.orderBy(m)).alias(m) for m in "abc"])
    assert _rows(got, "kabc") == _rows(want, "kabc")
    assert [tuple(r) for r in S.percent_ranks(df.filter("k = 5"), "k", ["b"]).select("b").collect()] == [(0.0,)]
    assert S.percent_ranks(df.limit(0), "k", ["b"]).count() == 0


def test_running_counts_do_not_depend_on_the_ranges(spark):
    rnd = random.Random(8)
    rows = [("m", v, rnd.randint(1, 9)) for v in sorted({rnd.randint(0, 500) for _ in range(200)})] + [("n", 1, 4), ("n", None, 2)]
    df = spark.createDataFrame(rows, "g string, v int, c long")
    want = sorted((g, str(v), sum(d for h, w, d in rows if h == g and v is not None and (w is None or w < v))) for g, v, _ in rows)
    for ranges in (2, 7, 200):
        got = S.running_counts(df, "g", "v", "c", "below", ranges).collect()
        assert sorted((r["g"], str(r["v"]), r["below"]) for r in got) == want


def test_rank_auc_equals_all_pairs(spark):
    rnd = random.Random(1)
    data = [(rnd.choice([0, 0, 1, None]), rnd.choice([0.5, 0.5, rnd.random()]), rnd.randint(0, 3) if rnd.random() < 0.9 else None) for _ in range(400)]
    got = {r["score"]: r for r in S.rank_auc(spark.createDataFrame(data, "y int, s double, t int"), "y", ["s", "t"]).collect()}
    for k, name in ((1, "s"), (2, "t")):
        pos = [r[k] for r in data if r[0] == 1 and r[k] is not None]
        neg = [r[k] for r in data if r[0] == 0 and r[k] is not None]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert (got[name]["positives"], got[name]["negatives"]) == (len(pos), len(neg))
        assert got[name]["auc"] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
    alone = spark.createDataFrame([(1, 0.5)], "y int, s double")
    assert [r["auc"] for r in S.rank_auc(alone, "y", ["s"]).collect()] == [None]
