"""Plans for the statistical tests (T1-T5) and the report table."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitlens.operators import multitest as mt
from splitlens.operators import report as rep
from splitlens.operators import results as res
from splitlens.operators import stats as S
from splitlens.pinned import ALPHA, EXP_ID, ONE_SAMPLE_NULL, STAT_DP, WINDOW_END, WINDOW_START
from splitlens.plans.common import IN_WINDOW, duck_chi2_sf, duck_norm_p2, duck_variant
from splitlens.plans.experiment import _TOTAL_CTE
from splitlens.plans.registry import query
from splitlens.sources.tables import read_table

V_CUST = duck_variant("c_custkey")


def _total(spark, sf):
    return res.result_total(read_table(spark, sf, "customer"), read_table(spark, sf, "orders"),
                            EXP_ID, WINDOW_START, WINDOW_END)


def _segments(spark, sf):
    return res.segment_result(read_table(spark, sf, "customer"), read_table(spark, sf, "orders"),
                              EXP_ID, WINDOW_START, WINDOW_END)


def _duck_chi2(cells_cte: str) -> str:
    """Chi-square over a CTE ``cells(r, c, o)`` with Yates only when dof = 1."""
    return f"""
{cells_cte},
d AS (SELECT (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS dof FROM cells),
e AS (SELECT r, c, o, (sum(o) OVER (PARTITION BY r)) * (sum(o) OVER (PARTITION BY c))
                      / (sum(o) OVER ()) AS ex FROM cells),
s AS (SELECT sum(power(CASE WHEN d.dof = 1 THEN o + sign(ex - o) * least(0.5, abs(ex - o))
                             ELSE o END - ex, 2) / ex) AS x FROM e, d)
SELECT round(x, 6) AS statistic, CAST(dof AS BIGINT) AS dof,
       round({duck_chi2_sf('x', 'dof')}, 6) AS p_value
FROM s, d"""


# ---------------------------------------------------------------- T1 / T2
@query("chi2_expected", f"""
WITH {_TOTAL_CTE},
cells AS (SELECT variant, 'converted' AS outcome, CAST(converted AS DOUBLE) AS observed FROM t
          UNION ALL SELECT variant, 'not_converted', CAST(units - converted AS DOUBLE) FROM t)
SELECT variant, outcome, observed,
       round(sum(observed) OVER (PARTITION BY variant) * sum(observed) OVER (PARTITION BY outcome)
             / sum(observed) OVER (), 6) AS expected
FROM cells""")
def q_chi2_expected(spark, sf):
    cells = S.expected_counts(S.contingency(_total(spark, sf)), "variant", "outcome")
    return cells.withColumn("expected", F.round("expected", STAT_DP))


@query("contingency", f"""
WITH {_TOTAL_CTE}
SELECT variant, 'converted' AS outcome, CAST(converted AS BIGINT) AS n FROM t
UNION ALL
SELECT variant, 'not_converted' AS outcome, CAST(units - converted AS BIGINT) AS n FROM t""")
def q_contingency(spark, sf):
    return S.contingency(_total(spark, sf))


@query("chi2_2x2", _duck_chi2(f"""WITH {_TOTAL_CTE},
cells AS (SELECT variant AS r, 'converted' AS c, CAST(converted AS DOUBLE) AS o FROM t
          UNION ALL
          SELECT variant, 'not_converted', CAST(units - converted AS DOUBLE) FROM t)"""))
def q_chi2_2x2(spark, sf):
    return S.chi2_test(S.contingency(_total(spark, sf)), "variant", "outcome", correction=True)


SEG_CTE = f"""
seg AS (
  SELECT c.c_mktsegment AS segment, {V_CUST} AS variant, count(*) AS n, count(m.o_custkey) AS x
  FROM customer c
  LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE {IN_WINDOW}) m
    ON c.c_custkey = m.o_custkey
  GROUP BY 1, 2),
sw AS (
  SELECT segment,
         max(x) FILTER (WHERE variant = 'A') AS xa, max(n) FILTER (WHERE variant = 'A') AS na,
         max(x) FILTER (WHERE variant = 'B') AS xb, max(n) FILTER (WHERE variant = 'B') AS nb
  FROM seg GROUP BY 1),
sz AS (
  SELECT *, (xa / na - xb / nb)
            / sqrt(((xa + xb) / (na + nb)) * (1 - (xa + xb) / (na + nb)) * (1 / na + 1 / nb)) AS z
  FROM sw),
fam AS (SELECT *, {duck_norm_p2('z')} AS p FROM sz)"""


@query("chi2_rxc", _duck_chi2(f"""WITH {SEG_CTE},
cells AS (SELECT variant AS r, segment AS c, CAST(x AS DOUBLE) AS o FROM seg)"""))
def q_chi2_rxc(spark, sf):
    return S.chi2_test(_segments(spark, sf), "variant", "segment", "converted")


# ---------------------------------------------------------------- T3
_WIDE = f"""WITH {_TOTAL_CTE},
w AS (SELECT max(converted) FILTER (WHERE variant = 'A') AS xa,
             max(units) FILTER (WHERE variant = 'A') AS na,
             max(converted) FILTER (WHERE variant = 'B') AS xb,
             max(units) FILTER (WHERE variant = 'B') AS nb FROM t),
pooled AS (SELECT *, (xa + xb) / (na + nb) AS pp FROM w)"""


@query("ztest_two_sample", f"""{_WIDE},
z AS (SELECT (xa / na - xb / nb) / sqrt(pp * (1 - pp) * (1 / na + 1 / nb)) AS z FROM pooled)
SELECT round(z, 6) AS z, round({duck_norm_p2('z')}, 6) AS p_value FROM z""")
def q_ztest_two_sample(spark, sf):
    w = S.ztest_two_sample(S.wide_by_variant(_total(spark, sf)),
                           "converted_A", "units_A", "converted_B", "units_B")
    return w.select(F.round("z", STAT_DP).alias("z"), F.round("p_value", STAT_DP).alias("p_value"))


MARGIN = -0.02          # B may be worse by two points
MARGIN_VAR = 0.15


@query("ztest_margin", f"""{_WIDE},
z AS (SELECT (xb * 1.0 / nb - xa * 1.0 / na - ({MARGIN})) / sqrt({MARGIN_VAR} * (1 - {MARGIN_VAR}) * (1.0 / na + 1.0 / nb)) AS z FROM w)
SELECT round(z, 6) AS z,
       round(CASE WHEN z >= 0 THEN {duck_norm_p2('z')} / 2 ELSE 1 - {duck_norm_p2('z')} / 2 END, 6) AS p_value
FROM z""")
def q_ztest_margin(spark, sf):
    """Non-inferiority: is B better than A minus the margin, with a planned variance."""
    w = S.ztest_two_sample(S.wide_by_variant(_total(spark, sf)), "converted_B", "units_B", "converted_A", "units_A",
                           "larger", MARGIN, MARGIN_VAR)
    return w.select(F.round("z", STAT_DP).alias("z"), F.round("p_value", STAT_DP).alias("p_value"))


@query("ztest_one_sample", f"""{_WIDE},
z AS (SELECT (xb / nb - {ONE_SAMPLE_NULL}) / sqrt((xb / nb) * (1 - xb / nb) / nb) AS z FROM pooled)
SELECT round(z, 6) AS z, round({duck_norm_p2('z')}, 6) AS p_value FROM z""")
def q_ztest_one_sample(spark, sf):
    w = S.ztest_one_sample(S.wide_by_variant(_total(spark, sf)), "converted_B", "units_B",
                           ONE_SAMPLE_NULL)
    return w.select(F.round("z", STAT_DP).alias("z"), F.round("p_value", STAT_DP).alias("p_value"))


@query("ztest_one_sided", f"""{_WIDE},
z AS (SELECT (xb / nb - xa / na) / sqrt(pp * (1 - pp) * (1 / na + 1 / nb)) AS z FROM pooled)
SELECT round(z, 6) AS z,
       round(CASE WHEN z >= 0 THEN {duck_norm_p2('z')} / 2
                  ELSE 1 - {duck_norm_p2('z')} / 2 END, 6) AS p_value
FROM z""")
def q_ztest_one_sided(spark, sf):
    w = S.ztest_two_sample(S.wide_by_variant(_total(spark, sf)),
                           "converted_B", "units_B", "converted_A", "units_A", "larger")
    return w.select(F.round("z", STAT_DP).alias("z"), F.round("p_value", STAT_DP).alias("p_value"))


# ---------------------------------------------------------------- T4
_POST = f"""WITH {_TOTAL_CTE},
post AS (SELECT variant, 1 + converted AS a, 1 + units - converted AS b FROM t)"""


@query("beta_posterior", f"""{_POST}
SELECT variant, CAST(a AS BIGINT) AS alpha, CAST(b AS BIGINT) AS beta,
       round(a / (a + b), 6) AS mean FROM post""")
def q_beta_posterior(spark, sf):
    return S.beta_posterior(_total(spark, sf))


def _lbeta(x: str, y: str) -> str:
    return f"(lgamma({x}) + lgamma({y}) - lgamma(({x}) + ({y})))"


@query("beta_prob_b_beats_a", f"""{_POST},
pw AS (SELECT max(a) FILTER (WHERE variant = 'A') AS aa, max(b) FILTER (WHERE variant = 'A') AS ba,
              max(a) FILTER (WHERE variant = 'B') AS ab, max(b) FILTER (WHERE variant = 'B') AS bb
       FROM post),
idx AS (SELECT aa, ba, bb, unnest(range(0, CAST(ab AS BIGINT))) AS i FROM pw)
SELECT round(least(1.0, sum(exp({_lbeta('aa + i', 'ba + bb')} - ln(bb + i)
                                 - {_lbeta('1 + i', 'bb')} - {_lbeta('aa', 'ba')}))), 6) AS prob
FROM idx""")
def q_beta_prob(spark, sf):
    return S.prob_b_beats_a(S.beta_posterior(_total(spark, sf)))


@query("beta_interval", f"""{_POST},
w AS (SELECT variant, a, b, a / (a + b) AS m, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0))) AS sd FROM post),
e AS (SELECT variant, a, b, greatest(0.0, m - 12 * sd) AS l, least(1.0, m + 12 * sd) AS u FROM w),
g AS (SELECT variant, a, b, (u - l) / 200000 AS h, l + (j + 0.5) * (u - l) / 200000 AS p FROM e, range(0, 200000) r(j)),
l AS (SELECT variant, p, h, (a - 1) * ln(p) + (b - 1) * ln(1 - p) AS ld FROM g),
d AS (SELECT variant, p, h, exp(ld - max(ld) OVER (PARTITION BY variant)) AS dn FROM l),
n AS (SELECT variant, p, h, dn / sum(dn) OVER (PARTITION BY variant) AS dn FROM d),
c AS (SELECT variant, p, h, dn, sum(dn) OVER (PARTITION BY variant ORDER BY p
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cdf FROM n)
SELECT variant, round(arg_min(p + h / 2 - h * (cdf - 0.025) / dn, p) FILTER (WHERE cdf >= 0.025), 5) AS lo,
       round(arg_min(p + h / 2 - h * (cdf - 0.975) / dn, p) FILTER (WHERE cdf >= 0.975), 5) AS hi
FROM c WHERE dn > 1e-300 GROUP BY variant""")
def q_beta_interval(spark, sf):
    return S.beta_interval(S.beta_posterior(_total(spark, sf)))


# ---------------------------------------------------------------- T5
_RANKED = """r AS (SELECT segment, p, CAST(row_number() OVER (ORDER BY p, segment) AS DOUBLE) AS k,
                  CAST(count(*) OVER () AS DOUBLE) AS m FROM fam)"""
_UP = "OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DOWN = "OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

_HOMMEL = """
oth AS (SELECT a.segment AS i, b.p AS op,
               row_number() OVER (PARTITION BY a.segment ORDER BY b.p DESC, b.segment DESC) AS orank
        FROM r a JOIN r b ON a.segment <> b.segment),
js AS (SELECT r.segment AS i, r.p AS ip, j FROM r, range(1, CAST((SELECT max(m) FROM r) AS BIGINT) + 1) t(j)),
mem AS (SELECT i, j, ip AS v FROM js
        UNION ALL
        SELECT js.i, js.j, oth.op FROM js JOIN oth ON js.i = oth.i AND oth.orank <= js.j - 1),
rk AS (SELECT i, j, v, row_number() OVER (PARTITION BY i, j ORDER BY v) AS rr FROM mem),
si AS (SELECT i, j, min(v * j / rr) AS s FROM rk GROUP BY i, j),
ho AS (SELECT i AS segment, least(1.0, max(s)) AS adj FROM si GROUP BY i)"""


def _mt_sql(method: str) -> str:
    head = f"WITH {SEG_CTE},\n{_RANKED}"
    if method == "hommel":
        return f"""{head},{_HOMMEL}
SELECT r.segment, round(r.p, 6) AS p_value, round(ho.adj, 6) AS p_adj, ho.adj <= {ALPHA} AS reject
FROM r JOIN ho ON r.segment = ho.segment"""
    if method in ("fdr_tsbh", "fdr_tsbky"):
        fact = 1.0 if method == "fdr_tsbh" else 1.0 + ALPHA
        a1 = ALPHA / fact
        return f"""{head},
bh AS (SELECT *, least(1.0, min(p * m / k) {_DOWN}) AS bh FROM r),
r1 AS (SELECT *, sum(CASE WHEN bh <= {a1} THEN 1 ELSE 0 END) OVER () AS r1 FROM bh),
adj AS (SELECT *, least(1.0, CASE WHEN r1 = 0 OR r1 = m THEN bh * {fact}
                                  ELSE bh * (m - r1) / m * {fact} END) AS adj FROM r1)
SELECT segment, round(p, 6) AS p_value, round(adj, 6) AS p_adj, adj <= {ALPHA} AS reject FROM adj"""
    expr = {
        "bonferroni": "least(1.0, p * m)",
        "sidak": "1 - power(1 - p, m)",
        "holm": f"least(1.0, max(p * (m - k + 1)) {_UP})",
        "holm_sidak": f"least(1.0, max(1 - power(1 - p, m - k + 1)) {_UP})",
        "simes_hochberg": f"least(1.0, min(p * (m - k + 1)) {_DOWN})",
        "fdr_bh": f"least(1.0, min(p * m / k) {_DOWN})",
        "fdr_by": ("least(1.0, min(p * m * list_sum(list_transform(range(1, CAST(m AS BIGINT) + 1), "
                   f"lambda j: 1.0 / j)) / k) {_DOWN})"),
    }[method]
    return f"""{head},
adj AS (SELECT *, {expr} AS adj FROM r)
SELECT segment, round(p, 6) AS p_value, round(adj, 6) AS p_adj, adj <= {ALPHA} AS reject FROM adj"""


def _register_mt(method: str) -> None:
    @query(f"mt_{method}", _mt_sql(method))
    def q(spark, sf):
        return rep.family_adjusted(_segments(spark, sf), method)


for _m in mt.METHODS:
    _register_mt(_m)


@query("mt_alphas", f"""WITH {SEG_CTE},
{_RANKED}
SELECT CAST(count(p) AS BIGINT) AS m, round(1 - power(1 - {ALPHA}, 1.0 / count(p)), 6) AS alpha_sidak,
       round({ALPHA} / count(p), 6) AS alpha_bonferroni FROM r""")
def q_mt_alphas(spark, sf):
    family = rep.family_adjusted(_segments(spark, sf), "bonferroni").filter(F.col("p_value").isNotNull())
    return mt.corrected_alphas(family).select("m", F.round("alpha_sidak", STAT_DP).alias("alpha_sidak"),
                                              F.round("alpha_bonferroni", STAT_DP).alias("alpha_bonferroni"))


@query("ab_report", f"""WITH {SEG_CTE},
{_RANKED},
adj AS (SELECT segment, least(1.0, max(1 - power(1 - p, m - k + 1)) {_UP}) AS adj FROM r)
SELECT fam.segment, round(xa / na, 4) AS cvr_a, round(xb / nb, 4) AS cvr_b,
       round((xb / nb) / nullif(xa / na, 0) - 1, 4) AS lift, round(z, 6) AS z,
       round(p, 6) AS p_value, round(adj, 6) AS p_adj, adj <= {ALPHA} AS reject
FROM fam JOIN adj ON fam.segment = adj.segment""")
def q_ab_report(spark, sf):
    return rep.report(_segments(spark, sf), "holm_sidak")
