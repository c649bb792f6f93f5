"""Models: a planted signal is found on held-out rows, NULLs do not stop the fit."""

import random

import numpy as np

from splitlens.operators import modeling as M


def test_churn_model_finds_a_planted_signal(spark):
    rnd = random.Random(2)
    data = []
    for i in range(1200):
        recency = rnd.randint(0, 400)
        data.append((i, int(recency > 200), recency, rnd.randint(1, 9), None if i % 7 == 0 else rnd.random() * 1e4))
    data.append((5000, None, 10, 1, 1.0))
    df = spark.createDataFrame(data, "c_custkey long, churned int, recency_days int, frequency long, monetary double")
    scored = M.churn_model(df, max_iter=3)
    assert scored.count() == len(data)
    n = {(r["churned"], r["prediction"]): r["n"] for r in M.churn_confusion(scored).collect()}
    assert sum(n.values()) > 150 and n.get((0, 0), 0) + n.get((1, 1), 0) >= 0.95 * sum(n.values())


def test_churn_model_without_two_classes(spark):
    df = spark.createDataFrame([(i, 1, i, 1, 1.0) for i in range(20)], "c_custkey long, churned int, recency_days int, frequency long, monetary double")
    assert {r["prediction"] for r in M.churn_model(df).collect()} == {1}
    assert M.churn_model(df.limit(0)).count() == 0


def test_price_model_with_nulls(spark):
    rows = [(i, f"b{i % 3}", f"t{i % 4}", i % 11, 100.0 * (i % 3) + 7 * (i % 4)) for i in range(300)]
    rows += [(900, None, "t1", 3, 5.0), (901, "b1", None, None, 5.0), (902, "b1", "t1", 4, None)]
    df = spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double")
    got = {r["p_partkey"]: r["prediction"] for r in M.price_model(df).collect()}
    assert len(got) == len(rows) and abs(got[5] - rows[5][4]) < 20 and got[902] is not None


def test_churn_evaluation_counts_the_held_out_rows(spark):
    rnd = random.Random(5)
    data = [(i, int(rnd.random() < 0.4), rnd.randint(0, 3), 1, 1.0) for i in range(600)]
    data = [(i, y, 300 + r if y and i % 5 else r, f, m) for i, y, r, f, m in data]     # recency tells most churners
    df = spark.createDataFrame(data, "c_custkey long, churned int, recency_days int, frequency long, monetary double")
    scored = M.churn_scores(df, max_iter=3).cache()
    got = M.churn_evaluation(scored).collect()
    rows = [r for r in scored.collect() if r["held_out"]]
    hits = lambda y, p: sum(r["churned"] == y and r["prediction"] == p for r in rows)
    pos, neg = ([r["probability"] for r in rows if r["churned"] == y] for y in (1, 0))
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert [tuple(r)[:6] for r in got] == [(len(rows), len(pos), hits(1, 1), hits(0, 1), hits(1, 0), hits(0, 0))]
    assert abs(got[0]["auc"] - wins / len(pos) / len(neg)) < 1e-6 and got[0]["auc"] > 0.8
    assert sum(r["n"] for r in M.churn_confusion(scored).collect()) == len(rows)
    empty = M.churn_evaluation(M.churn_scores(df.limit(0))).collect()
    assert [(r["customers"], r["auc"]) for r in empty] == [(0, None)]


def test_price_regression_equals_least_squares(spark):
    rnd = random.Random(9)
    data = [(i, rnd.choice(["a", "a", "b", None]), rnd.choice([None, *range(1, 30)]), round(rnd.uniform(5, 90), 2) if i % 11 else None) for i in range(400)]
    data.append((9000, "unseen", 4, None))
    df = spark.createDataFrame(data, "p_partkey long, p_brand string, p_size int, p_retailprice double")
    got = {r["p_partkey"]: r for r in M.price_regression(df).collect()}
    fit = [r for r in data if r[3] is not None and not got[r[0]]["held_out"]]
    brands = ["a", "b", None]
    design = np.array([[float(r[1] == b) for b in brands] + [r[2] or 0] for r in fit])
    coef = np.linalg.lstsq(design, np.array([r[3] for r in fit]), rcond=None)[0]
    assert 0.1 * len(data) < sum(r["held_out"] for r in got.values()) < 0.3 * len(data)
    for k, brand, size, _ in data[:-1]:
        assert abs(got[k]["prediction"] - coef[brands.index(brand)] - coef[3] * (size or 0)) < 1e-3
    overall = np.mean([r[3] for r in fit]) - coef[3] * np.mean([r[2] or 0 for r in fit])
    assert abs(got[9000]["prediction"] - overall - 4 * coef[3]) < 1e-3
    report = {r["held_out"]: r for r in M.price_evaluation(M.price_regression(df)).collect()}
    left = [got[r[0]]["prediction"] - r[3] for r in data if r[3] is not None and got[r[0]]["held_out"]]
    assert report[True]["parts"] == len(left) and abs(report[True]["mae"] - np.mean(np.abs(left))) < 1e-3
    assert {r["prediction"] for r in M.price_regression(df.filter("p_retailprice IS NULL")).collect()} == {None}


def test_price_regression_finds_a_planted_slope(spark):
    rnd = random.Random(4)
    data = [(i, f"b{i % 5}", i % 50, 10.0 * (i % 5) + 2 * (i % 50) + rnd.gauss(0, 0.5)) for i in range(1500)]
    scored = M.price_regression(spark.createDataFrame(data, "p_partkey long, p_brand string, p_size int, p_retailprice double"))
    report = {r["held_out"]: r for r in M.price_evaluation(scored).collect()}
    assert report[True]["r2"] > 0.99 and report[True]["rmse"] < 0.6
