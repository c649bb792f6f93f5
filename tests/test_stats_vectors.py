"""Known-answer vectors for the statistics (closed forms computed by hand / math.erfc)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitlens.functions import numeric as N
from splitlens.operators import multitest as mt
from splitlens.operators import stats as S


def one(df):
    return df.collect()[0]


def test_ln_gamma_matches_math(spark):
    zs = [0.5, 1.0, 1.5, 2.0, 7.5, 100.25, 7511.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(N.ln_gamma("z")).collect()]
    for z, g in zip(zs, got):
        assert abs(g - math.lgamma(z)) < 1e-10 * max(1.0, abs(math.lgamma(z)))


@pytest.mark.parametrize("z", [0.5, 1.0, 1.96, 2.58, 4.0])
def test_normal_two_sided_matches_erfc(spark, z):
    got = one(spark.range(1).select(N.norm_two_sided_p(z)))[0]
    assert abs(got - math.erfc(z / math.sqrt(2))) < 1e-10


def test_chi2_tail_dof3(spark):
    got = one(spark.range(1).select(N.chi2_sf(7.815, 3)))[0]
    assert round(got, 6) == 0.049994


def _cells(spark, table):
    rows = [(f"r{i}", f"c{j}", n) for i, row in enumerate(table) for j, n in enumerate(row)]
    return spark.createDataFrame(rows, "r string, c string, n long")


def test_chi2_2x2_plain_and_yates(spark):
    cells = _cells(spark, [[30, 10], [20, 20]])
    plain = one(S.chi2_test(cells, "r", "c", correction=False))
    assert plain["statistic"] == 5.333333 and plain["dof"] == 1 and plain["p_value"] == 0.020921
    yates = one(S.chi2_test(cells, "r", "c", correction=True))
    assert yates["statistic"] == 4.32 and yates["p_value"] == 0.037667


def test_chi2_conversion_table(spark):
    cells = _cells(spark, [[115, 629], [133, 623]])
    assert one(S.chi2_test(cells, "r", "c", correction=False))["statistic"] == 1.239285
    assert one(S.chi2_test(cells, "r", "c", correction=True))["statistic"] == 1.08936


def test_chi2_2x3(spark):
    r = one(S.chi2_test(_cells(spark, [[115, 400, 229], [133, 380, 243]]), "r", "c"))
    assert (r["statistic"], r["dof"], r["p_value"]) == (2.138663, 2, 0.343238)


def test_chi2_zero_expected_is_null(spark):
    r = one(S.chi2_test(_cells(spark, [[0, 10], [0, 20]]), "r", "c"))
    assert r["statistic"] is None and r["p_value"] is None


def test_ztest_two_sample(spark):
    df = spark.createDataFrame([(115, 744, 133, 756)], "x1 long, n1 long, x2 long, n2 long")
    r = one(S.ztest_two_sample(df, "x1", "n1", "x2", "n2")
            .select(F.round("z", 6), F.round("p_value", 6)))
    assert (r[0], r[1]) == (-1.113232, 0.265609)
    # without Yates, chi-square of the same 2x2 table equals z^2
    assert abs(1.239285 - 1.113232 ** 2) < 1e-5


def test_ztest_zero_variance_is_null(spark):
    df = spark.createDataFrame([(0, 10, 0, 10)], "x1 long, n1 long, x2 long, n2 long")
    r = one(S.ztest_two_sample(df, "x1", "n1", "x2", "n2").select("z", "p_value"))
    assert r[0] is None and r[1] is None


def _post(spark, xa, na, xb, nb):
    res = spark.createDataFrame([("A", na, xa), ("B", nb, xb)],
                                "variant string, units long, converted long")
    return S.beta_posterior(res)


def test_prob_b_beats_a(spark):
    assert one(S.prob_b_beats_a(_post(spark, 115, 744, 133, 756)))["prob"] == 0.866718
    assert one(S.prob_b_beats_a(_post(spark, 1179, 7510, 1218, 7490)))["prob"] == 0.826418


def _beta_density(a, b, n=400_000):
    """(p, weight) of a Beta posterior over a fine log-odds grid."""
    x = np.linspace(np.log(a / b) - 12 * np.sqrt(1 / a + 1 / b) - 30 / a, np.log(a / b) + 12 * np.sqrt(1 / a + 1 / b) + 30 / b, n)
    d = -a * np.log1p(np.exp(-x)) - b * np.log1p(np.exp(x))
    d = np.exp(d - d.max())
    return 1 / (1 + np.exp(-x)), d / d.sum()


@pytest.mark.parametrize("xa,na,xb,nb,prior", [(115, 744, 133, 756, 1), (115, 744, 133, 756, 0.5), (0, 30, 2, 40, 0.5), (160, 1000, 162_000_000, 1_000_000_000, 1)])
def test_beta_against_quadrature(spark, xa, na, xb, nb, prior):
    res = spark.createDataFrame([("A", na, xa), ("B", nb, xb)], "variant string, units long, converted long")
    post = S.beta_posterior(res, prior, prior)
    grids = {"A": _beta_density(xa + prior, na - xa + prior), "B": _beta_density(xb + prior, nb - xb + prior)}
    for r in S.beta_interval(post).collect():
        p, w = grids[r["variant"]]
        lo, hi = np.interp([0.025, 0.975], np.cumsum(w) - w / 2, p)
        assert (r["lo"], r["hi"]) == pytest.approx((lo, hi), abs=6e-6)
    (pa, wa), (pb, wb) = grids["A"], grids["B"]
    want = np.sum(wb * np.interp(pb, pa, np.cumsum(wa) - wa / 2, 0, 1)) if na < nb * 100 and nb < na * 100 else \
        np.interp(np.sum(pb * wb), pa, np.cumsum(wa) - wa / 2)
    assert one(S.prob_b_beats_a(post))["prob"] == pytest.approx(want, abs=2e-6)


PV = [0.01, 0.04, 0.03, 0.005, 0.5]
EXPECTED = {
    "bonferroni": [0.05, 0.2, 0.15, 0.025, 1],
    "sidak": [0.04901, 0.184627, 0.141266, 0.024751, 0.96875],
    "holm": [0.04, 0.09, 0.09, 0.025, 0.5],
    "holm_sidak": [0.039404, 0.087327, 0.087327, 0.024751, 0.5],
    "simes_hochberg": [0.04, 0.08, 0.08, 0.025, 0.5],
    "hommel": [0.04, 0.08, 0.06, 0.025, 0.5],
    "fdr_bh": [0.025, 0.05, 0.05, 0.025, 0.5],
    "fdr_by": [0.057083, 0.114167, 0.114167, 0.057083, 1],
}


@pytest.mark.parametrize("method", sorted(EXPECTED))
def test_multitest_vectors(spark, method):
    df = spark.createDataFrame(list(enumerate(PV)), "i long, p double")
    got = {r["i"]: r["p_adj"] for r in mt.adjust(df, "p", method, tiebreak=["i"]).collect()}
    assert [got[i] for i in range(5)] == pytest.approx(EXPECTED[method], abs=1e-6)


def _two_stage(p, alpha, bky):
    """Two-stage step-up from the published definitions, one iteration."""
    p = np.asarray(p, float)
    m = len(p)
    order = np.argsort(p, kind="mergesort")
    ps = p[order]
    bh = np.minimum.accumulate((ps * m / np.arange(1, m + 1))[::-1])[::-1]
    bh = np.minimum(bh, 1)
    fact = 1 + alpha if bky else 1.0
    r1 = int((bh <= alpha / fact).sum())
    adj = bh * fact if r1 in (0, m) else bh * (m - r1) / m * fact
    out = np.empty(m)
    out[order] = np.minimum(adj, 1)
    return out


@pytest.mark.parametrize("method", ["fdr_tsbh", "fdr_tsbky"])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_two_stage_matches_definition(spark, method, seed):
    rng = np.random.default_rng(seed)
    p = np.round(np.concatenate([rng.uniform(0, 0.02, 4), rng.uniform(0, 1, 8)]), 6)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i long, p double")
    got = {r["i"]: r["p_adj"] for r in mt.adjust(df, "p", method, tiebreak=["i"],
                                                 round_dp=None).collect()}
    exp = _two_stage(p, 0.05, method == "fdr_tsbky")
    assert [got[i] for i in range(len(p))] == pytest.approx(list(exp), abs=1e-12)


def _simes(vals):
    s = sorted(vals)
    return min(s[r] * len(s) / (r + 1) for r in range(len(s)))


def _hommel_closed_testing(p):
    """Brute force: max over all intersections containing i of the Simes p-value."""
    from itertools import combinations
    m = len(p)
    out = []
    for i in range(m):
        best = 0.0
        others = [j for j in range(m) if j != i]
        for r in range(0, m):
            for combo in combinations(others, r):
                best = max(best, _simes([p[i]] + [p[j] for j in combo]))
        out.append(min(best, 1.0))
    return out


def test_expected_counts(spark):
    e = {(r["r"], r["c"]): r["expected"]
         for r in S.expected_counts(_cells(spark, [[30, 10], [20, 20]]), "r", "c").collect()}
    assert e == {("r0", "c0"): 25.0, ("r0", "c1"): 15.0, ("r1", "c0"): 25.0, ("r1", "c1"): 15.0}


def test_corrected_alphas(spark):
    df = spark.createDataFrame([(float(p),) for p in PV], "p double")
    r = one(mt.corrected_alphas(df))
    assert r["m"] == 5
    assert r["alpha_bonferroni"] == pytest.approx(0.01)
    assert r["alpha_sidak"] == pytest.approx(1 - 0.95 ** 0.2)


@pytest.mark.parametrize("seed", range(5))
def test_hommel_spark_equals_closed_testing(spark, seed):
    rng = np.random.default_rng(100 + seed)
    m = int(rng.integers(1, 9))
    p = np.round(rng.uniform(0, 0.2, m), 6)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i long, p double")
    got = {r["i"]: r["p_adj"] for r in mt.adjust(df, "p", "hommel", tiebreak=["i"],
                                                 round_dp=None).collect()}
    exp = _hommel_closed_testing(list(p))
    assert [got[i] for i in range(m)] == pytest.approx(exp, abs=1e-12)


def test_contingency_wide(spark):
    res = spark.createDataFrame([("A", 744, 115), ("B", 756, 133)],
                                "variant string, units long, converted long")
    wide = S.contingency_wide(S.contingency(res), "variant", "outcome",
                              ["converted", "not_converted"])
    got = {r["variant"]: (r["converted"], r["not_converted"]) for r in wide.collect()}
    assert got == {"A": (115, 629), "B": (133, 623)}


def test_prob_b_beats_a_large_counts_matches_normal_limit(spark):
    """~200k successes: the exact sum runs over many chunks; at this size the Beta posteriors
    are close to normal, so Phi((muB - muA) / sqrt(varA + varB)) is a tight check."""
    xa, na, xb, nb = 200_000, 1_000_000, 201_000, 1_000_000
    got = one(S.prob_b_beats_a(_post(spark, xa, na, xb, nb)))["prob"]

    def mv(x, n):
        a, b = 1 + x, 1 + n - x
        return a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
    (ma, va), (mb, vb) = mv(xa, na), mv(xb, nb)
    approx = 0.5 * math.erfc(-(mb - ma) / math.sqrt(2 * (va + vb)))
    assert got == pytest.approx(approx, abs=2e-3)


@pytest.mark.parametrize("method", mt.METHODS)
def test_untested_hypotheses_leave_the_family(spark, method):
    rows = [(i, p) for i, p in enumerate(PV)] + [(9, None)]
    df = spark.createDataFrame(rows, "i long, p double")
    got = {r["i"]: (r["p_adj"], r["reject"]) for r in mt.adjust(df, "p", method, tiebreak=["i"]).collect()}
    assert got[9] == (None, None)
    base = spark.createDataFrame(list(enumerate(PV)), "i long, p double")
    want = {r["i"]: (r["p_adj"], r["reject"]) for r in mt.adjust(base, "p", method, tiebreak=["i"]).collect()}
    assert {k: v for k, v in got.items() if k != 9} == want


def test_harmonic_exact_and_asymptotic(spark):
    ms = [1, 2, 10, 1000, 1001, 5000, 10 ** 6]
    df = spark.createDataFrame([(m,) for m in ms], "m long")
    got = [r[0] for r in df.select(N.harmonic("m")).collect()]
    for m, g in zip(ms, got):
        want = math.fsum(1.0 / j for j in range(1, m + 1))
        assert g == pytest.approx(want, rel=1e-14), m
