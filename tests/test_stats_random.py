"""Randomised checks of the statistics against plain-Python implementations written from
the textbook definitions (families with ties, random contingency tables)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitlens.operators import multitest as mt
from splitlens.operators import stats as S


def _ref_adjust(p, method, alpha=0.05):
    """Adjusted p-values in input order, from the definitions (ties broken by position)."""
    m = len(p)
    order = sorted(range(m), key=lambda i: (p[i], i))
    ps = [p[i] for i in order]
    if method == "bonferroni":
        adj = [min(1.0, x * m) for x in ps]
    elif method == "sidak":
        adj = [1 - (1 - x) ** m for x in ps]
    elif method in ("holm", "holm_sidak"):
        adj, run = [], 0.0
        for k, x in enumerate(ps, 1):
            v = x * (m - k + 1) if method == "holm" else 1 - (1 - x) ** (m - k + 1)
            run = max(run, v)
            adj.append(min(1.0, run))
    elif method in ("simes_hochberg", "fdr_bh", "fdr_by"):
        cm = sum(1.0 / j for j in range(1, m + 1)) if method == "fdr_by" else 1.0
        raw = [x * (m - k + 1) if method == "simes_hochberg" else x * m * cm / k
               for k, x in enumerate(ps, 1)]
        adj, run = [0.0] * m, math.inf
        for k in range(m - 1, -1, -1):
            run = min(run, raw[k])
            adj[k] = min(1.0, run)
    elif method == "hommel":
        from tests.test_stats_vectors import _hommel_closed_testing
        adj = _hommel_closed_testing(ps)
    else:
        fact = 1.0 + alpha if method == "fdr_tsbky" else 1.0
        bh = _ref_adjust(p, "fdr_bh")
        bh_sorted = [bh[i] for i in order]
        r1 = sum(1 for x in bh_sorted if x <= alpha / fact)
        adj = [min(1.0, x * fact if r1 in (0, m) else x * (m - r1) / m * fact) for x in bh_sorted]
    out = [0.0] * m
    for pos, i in enumerate(order):
        out[i] = adj[pos]
    return out


@pytest.mark.parametrize("method", mt.METHODS)
def test_all_methods_on_random_families(spark, method):
    rnd = random.Random(hash(method) % 1000)
    rows, expected = [], {}
    for fam in range(12):
        m = rnd.randint(1, 9)
        # mix of small p-values, exact ties and large ones
        p = [round(rnd.choice([rnd.uniform(0, 0.01), rnd.uniform(0, 1), 0.02]), 4) for _ in range(m)]
        ref = _ref_adjust(p, method)
        for i, x in enumerate(p):
            rows.append((fam, i, x))
            expected[(fam, i)] = ref[i]
    df = spark.createDataFrame(rows, "fam int, i int, p double")
    got = {(r["fam"], r["i"]): r["p_adj"]
           for r in mt.adjust(df, "p", method, family=["fam"], tiebreak=["i"], round_dp=None).collect()}
    for key, val in expected.items():
        assert got[key] == pytest.approx(val, abs=1e-12), (method, key)


def _chi2_ref(table, correction):
    r, c = len(table), len(table[0])
    n = sum(map(sum, table))
    rows = [sum(row) for row in table]
    cols = [sum(table[i][j] for i in range(r)) for j in range(c)]
    dof = (r - 1) * (c - 1)
    stat = 0.0
    for i in range(r):
        for j in range(c):
            e = rows[i] * cols[j] / n
            o = table[i][j]
            if correction and dof == 1:
                d = e - o
                o = o + math.copysign(min(0.5, abs(d)), d) if d != 0 else o
            stat += (o - e) ** 2 / e
    return stat, dof


def _chi2_sf(x, dof):
    """Upper tail by closed forms: even dof via the Poisson sum, odd dof via erfc."""
    if dof % 2 == 0:
        k = dof // 2
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k))
    s = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(x / 2) * math.exp(-x / 2) / math.sqrt(math.pi) * 2
    for i in range(1, (dof - 1) // 2 + 1):
        s += term
        term *= x / (2 * i + 1)
    return s


def test_chi2_random_tables(spark):
    rnd = random.Random(11)
    for _ in range(6):
        r, c = rnd.randint(2, 3), rnd.randint(2, 5)
        table = [[rnd.randint(5, 400) for _ in range(c)] for _ in range(r)]
        cells = spark.createDataFrame([(f"r{i}", f"c{j}", table[i][j]) for i in range(r)
                                       for j in range(c)], "r string, c string, n long")
        got = S.chi2_test(cells, "r", "c").collect()[0]
        stat, dof = _chi2_ref(table, True)
        assert got["dof"] == dof
        assert got["statistic"] == pytest.approx(round(stat, 6), abs=1e-6)
        assert got["p_value"] == pytest.approx(round(_chi2_sf(stat, dof), 6), abs=1.5e-6)


def test_ztests_random(spark):
    rnd = random.Random(5)
    data = [(rnd.randint(1, 300), rnd.randint(400, 800), rnd.randint(1, 300), rnd.randint(400, 800))
            for _ in range(20)]
    df = spark.createDataFrame(data, "x1 long, n1 long, x2 long, n2 long")
    two = S.ztest_two_sample(df, "x1", "n1", "x2", "n2").collect()
    big = S.ztest_two_sample(df, "x1", "n1", "x2", "n2", "larger").collect()
    one = S.ztest_one_sample(df, "x1", "n1", 0.2).collect()
    for (x1, n1, x2, n2), a, b, c in zip(data, two, big, one):
        pp = (x1 + x2) / (n1 + n2)
        z = (x1 / n1 - x2 / n2) / math.sqrt(pp * (1 - pp) * (1 / n1 + 1 / n2))
        assert a["z"] == pytest.approx(z, rel=1e-12)
        assert a["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-10)
        assert b["p_value"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=1e-10)
        p1 = x1 / n1
        z1 = (p1 - 0.2) / math.sqrt(p1 * (1 - p1) / n1)
        assert c["z"] == pytest.approx(z1, rel=1e-12)
        assert c["p_value"] == pytest.approx(math.erfc(abs(z1) / math.sqrt(2)), abs=1e-10)


@pytest.mark.parametrize("method", mt.METHODS)
def test_distributed_equals_windowed(spark, method):
    rnd = random.Random(hash(method) % 997)
    rows = []
    for fam in (0, 1, 2, None):
        for i in range(rnd.choice([1, 7, 300])):
            rows.append((fam, i, round(rnd.choice([rnd.uniform(0, 0.001), rnd.uniform(0, 1), 0.5]), 5)))
    df = spark.createDataFrame(rows, "fam int, i int, p double")
    want = {(r["fam"], r["i"]): (r["p_adj"], r["reject"]) for r in
            mt.adjust(df, "p", method, family=["fam"], tiebreak=["i"], round_dp=None).collect()}
    got = {(r["fam"], r["i"]): (r["p_adj"], r["reject"]) for r in
           mt.adjust(df, "p", method, family=["fam"], tiebreak=["i"], round_dp=None,
                     distributed=True).collect()}
    assert got.keys() == want.keys() and len(want) == len(rows)
    for key in want:
        assert got[key][0] == pytest.approx(want[key][0], abs=1e-12), (method, key)
        assert got[key][1] == want[key][1]


def test_distributed_single_large_family(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.uniform(0, 1) if i % 50 else rnd.uniform(0, 1e-6)) for i in range(20000)]
    df = spark.createDataFrame(rows, "i long, p double")
    for method in ("holm", "fdr_bh", "hommel"):
        want = {r["i"]: r["p_adj"] for r in mt.adjust(df, "p", method, tiebreak=["i"], round_dp=None).collect()}
        got = {r["i"]: r["p_adj"] for r in mt.adjust(df, "p", method, tiebreak=["i"], round_dp=None,
                                                     distributed=True).collect()}
        assert max(abs(got[i] - want[i]) for i in want) < 1e-12


def _hommel_by_definition(p):
    """min over j of max(S(j), (j - 1) p): S(j) the Simes value of the j largest, all j and hypotheses tried."""
    s, m = np.sort(p), len(p)
    simes = np.array([np.min(j * s[m - j:] / np.arange(1, j + 1)) for j in range(1, m + 1)] + [0.0])
    return np.minimum(1, np.min(np.maximum(simes[:, None], np.arange(m + 1)[:, None] * p[None, :]), axis=0))


@pytest.mark.parametrize("shape", ["uniform", "signal", "ties", "convex", "zeros", "ones"])
@pytest.mark.parametrize("distributed", [False, True])
def test_hommel_by_the_hull_equals_the_definition(spark, monkeypatch, shape, distributed):
    monkeypatch.setattr(mt, "HULL_RUN", 37)       # many parts, merged in two steps
    monkeypatch.setattr(mt, "HULL_FAN", 3)
    rng = np.random.default_rng(7)
    m = 700
    p = {"uniform": rng.uniform(0, 1, m), "signal": np.where(rng.uniform(size=m) < 0.3, rng.uniform(0, 1e-4, m), rng.uniform(0, 1, m)),
         "ties": rng.choice([0.001, 0.02, 0.02, 0.5], m), "convex": (np.arange(1, m + 1) / m) ** 2,
         "zeros": np.where(np.arange(m) % 9 == 0, 0.0, rng.uniform(0, 1, m)), "ones": np.ones(m)}[shape]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i long, p double")
    got = mt.adjust(df, "p", "hommel", tiebreak=["i"], round_dp=None, distributed=distributed)
    got = np.array([r["p_adj"] for r in got.orderBy("i").collect()])
    assert np.allclose(got, _hommel_by_definition(p), rtol=1e-12, atol=1e-15)


def test_hommel_of_a_large_family(spark):
    """Half a million hypotheses: no rows in proportion to their square, no window over the family."""
    m = 500_000
    df = spark.range(m).select(F.col("id").alias("i"), F.when(F.col("id") % 100 == 0, F.rand(3) * 1e-8).otherwise(F.rand(4)).alias("p"))
    df = df.repartition(4).checkpoint()
    out = mt.adjust(df, "p", "hommel", tiebreak=["i"], round_dp=None, distributed=True)
    plan = out._jdf.queryExecution().analyzed().toString()
    # the family is a window key only together with a range partition, or over the few vertices of the hull and block tables
    assert "row_number" not in plan and "explode" not in plan.lower()
    got = np.array([(r["p"], r["p_adj"]) for r in out.select("p", "p_adj").collect()])
    holm = np.array([r["p_adj"] for r in mt.adjust(df, "p", "holm", tiebreak=["i"], round_dp=None, distributed=True).orderBy("p", "i").collect()])
    by_p = got[np.lexsort((got[:, 1], got[:, 0]))]
    assert len(got) == m and np.all(np.diff(by_p[:, 1]) >= -1e-12) and np.all(by_p[:, 1] >= by_p[:, 0] - 1e-15) and np.all(by_p[:, 1] <= holm + 1e-12)
    assert 0 < np.sum(by_p[:, 1] <= 0.05) <= m // 100 + 50
