"""Statistical tests on aggregated experiment results.

Inputs are small DataFrames of counts (one row per variant, or per cell of a contingency
table); all arithmetic stays in Spark column expressions.  Windows here are partitioned by
the test (``keys``) and run over a handful of rows per test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitlens.functions.numeric import (chi2_sf_sql, norm_cdf_sql, norm_p2_sql,
                                         norm_sf_sql, safe_div)
from splitlens.pinned import INTERVAL_DP, STAT_DP, VARIANTS


def _part(keys: Sequence[str], *more: str):
    cols = [*keys, *more]
    return Window.partitionBy(*cols) if cols else Window.partitionBy(F.lit(0))


# ---------------------------------------------------------------- T1 contingency table
def contingency(result: DataFrame, group_col: str = "variant", n_col: str = "units",
                x_col: str = "converted", keys: Sequence[str] = ()) -> DataFrame:
    """Long form ``[keys,] variant, outcome, n`` with outcomes converted / not_converted."""
    cells = F.array(
        F.struct(F.lit("converted").alias("outcome"), F.col(x_col).cast("bigint").alias("n")),
        F.struct(F.lit("not_converted").alias("outcome"),
                 (F.col(n_col) - F.col(x_col)).cast("bigint").alias("n")),
    )
    return (result.select(*keys, group_col, F.explode(cells).alias("c"))
            .select(*keys, group_col, "c.outcome", "c.n"))


def contingency_wide(cells: DataFrame, row_col: str, col_col: str, values: Sequence[str],
                     n_col: str = "n") -> DataFrame:
    """Wide form: one column per outcome value (explicit values, so no extra pass)."""
    return cells.groupBy(row_col).pivot(col_col, list(values)).agg(F.sum(n_col)).fillna(0)


# ---------------------------------------------------------------- T2 chi-square
def expected_counts(cells: DataFrame, row_col: str, col_col: str, n_col: str = "n",
                    keys: Sequence[str] = ()) -> DataFrame:
    """Expected frequencies under independence, ``row total * column total / total``, per cell
    (the ``expected`` table of a chi-square test)."""
    o = F.col(n_col).cast("double")
    return (cells.select(*keys, row_col, col_col, o.alias("observed"))
            .withColumn("expected", safe_div(
                F.sum("observed").over(_part(keys, row_col)) * F.sum("observed").over(_part(keys, col_col)),
                F.sum("observed").over(_part(keys)))))


def chi2_test(cells: DataFrame, row_col: str, col_col: str, n_col: str = "n",
              keys: Sequence[str] = (), correction: bool = True) -> DataFrame:
    """Pearson chi-square test of independence; cells that are absent count as zero.

    Without correction the statistic is ``N (sum O^2 / (R C) - 1)``, which needs the present cells
    only.  Yates' correction applies only when ``dof == 1``: all four cells are then equally far from
    their expectation, and that distance less ``min(0.5, distance)`` is squared over the four expected
    counts, which follow from the margins.  A zero margin gives NULL statistics; ``dof == 0``
    gives statistic 0 and p 1.
    """
    o = F.col(n_col).cast("double")
    by_row, by_col = _part(keys, row_col), _part(keys, col_col)
    c = cells.select(*keys, row_col, col_col, o.alias("_o"), F.sum(o).over(by_row).alias("_r"), F.sum(o).over(by_col).alias("_c"),
                     F.count(F.lit(1)).over(by_row).alias("_in_row"), F.count(F.lit(1)).over(by_col).alias("_in_col"),
                     F.sum(o).over(_part(keys)).alias("_n"),
                     ((F.size(F.collect_set(row_col).over(_part(keys))) - 1)
                      * (F.size(F.collect_set(col_col).over(_part(keys))) - 1)).alias("_dof"))
    one = F.lit(1.0)
    agg = (c.groupBy(*keys)
           .agg(F.sum(safe_div(F.col("_o") * F.col("_o"), F.col("_r") * F.col("_c"))).alias("_sum"), F.max("_n").alias("_n"),
                F.max("_dof").alias("_dof"), F.max(F.abs(F.col("_o") - safe_div(F.col("_r") * F.col("_c"), F.col("_n")))).alias("_far"),
                F.sum(safe_div(one, F.col("_r") * F.col("_in_row"))).alias("_rows"), F.sum(safe_div(one, F.col("_c") * F.col("_in_col"))).alias("_cols"),
                F.count_if((F.col("_r") == 0) | (F.col("_c") == 0) | F.col("_r").isNull() | F.col("_c").isNull()).alias("_bad")))
    moved = F.col("_far") - F.least(F.lit(0.5), F.col("_far"))
    plain = F.col("_n") * (F.col("_sum") - 1)
    agg = agg.withColumn("_stat", F.when(F.lit(correction) & (F.col("_dof") == 1), moved * moved * F.col("_n") * F.col("_rows") * F.col("_cols"))
                         .otherwise(F.greatest(F.lit(0.0), plain)))
    stat = (F.when(F.col("_dof") == 0, F.lit(0.0))
            .when(F.col("_bad") > 0, F.lit(None).cast("double"))
            .otherwise(F.col("_stat")))
    p = F.expr(f"CASE WHEN _dof = 0 THEN 1.0D ELSE {chi2_sf_sql('_x', '_dof')} END")
    return (agg.select(*keys, stat.alias("_x"), "_dof")
            .select(*keys, F.round("_x", STAT_DP).alias("statistic"),
                    F.col("_dof").cast("bigint").alias("dof"),
                    F.round(p, STAT_DP).alias("p_value")))


# ---------------------------------------------------------------- T3 proportion z-tests
def _p_sql(z: str, alternative: str) -> str:
    if alternative == "two-sided":
        return norm_p2_sql(z)
    if alternative == "larger":
        return norm_sf_sql(z)
    if alternative == "smaller":
        return norm_cdf_sql(z)
    raise ValueError(alternative)


def _d(a, b) -> str:
    return f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"


def ztest_two_sample(df: DataFrame, x1: str, n1: str, x2: str, n2: str,
                     alternative: str = "two-sided", value: float = 0.0,
                     prop_var: float | None = None) -> DataFrame:
    """Two-proportion z-test of ``x1/n1 - x2/n2 = value``; the variance uses the pooled proportion
    unless ``prop_var``.  Arguments are column names of ``df``; adds unrounded ``z`` and ``p_value``."""
    pooled = repr(float(prop_var)) if prop_var is not None else _d(f"{x1} + {x2}", f"{n1} + {n2}")
    se = f"sqrt({pooled} * (1 - {pooled}) * ({_d(1, n1)} + {_d(1, n2)}))"
    z = f"try_divide({_d(x1, n1)} - {_d(x2, n2)} - ({float(value)!r}), {se})"
    return (df.withColumn("z", F.expr(z))
            .withColumn("p_value", F.expr(_p_sql("z", alternative))))


def ztest_one_sample(df: DataFrame, x: str, n: str, value: float,
                     alternative: str = "two-sided", prop_var: float | None = None) -> DataFrame:
    """One-proportion z-test; the variance uses the sample proportion unless ``prop_var``."""
    p = _d(x, n)
    pv = repr(float(prop_var)) if prop_var is not None else p
    se = f"sqrt(try_divide({pv} * (1 - {pv}), CAST({n} AS DOUBLE)))"
    z = f"try_divide({p} - {float(value)!r}, {se})"
    return (df.withColumn("z", F.expr(z))
            .withColumn("p_value", F.expr(_p_sql("z", alternative))))


def wide_by_variant(result: DataFrame, keys: Sequence[str] = (), variants=VARIANTS,
                    cols: Sequence[str] = ("units", "converted")) -> DataFrame:
    """One row per test with ``<col>_<variant>`` columns (e.g. ``units_A``)."""
    aggs = [F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{c}_{v}")
            for v in variants for c in cols]
    return result.groupBy(*keys).agg(*aggs)


# ---------------------------------------------------------------- T4 Beta posterior
def beta_posterior(result: DataFrame, prior_a: float = 1.0, prior_b: float = 1.0,
                   keys: Sequence[str] = ()) -> DataFrame:
    a = F.lit(prior_a) + F.col("converted")
    b = F.lit(prior_b) + F.col("units") - F.col("converted")
    return result.select(*keys, "variant",
                         a.cast("bigint" if float(prior_a).is_integer() else "double").alias("alpha"),
                         b.cast("bigint" if float(prior_b).is_integer() else "double").alias("beta"),
                         F.round(safe_div(a, a + b), STAT_DP).alias("mean"))


# Points of a posterior's grid.  The grid spans the posterior (not [0, 1]) on the log-odds axis,
# where the density p^a (1-p)^b is smooth for every a, b > 0, so its accuracy does not depend on the sample size.
GRID_POINTS = 20_000


def _grid(df: DataFrame, a: str, b: str, points: int) -> DataFrame:
    """Rows of ``df`` times ``points + 1`` grid points: ``_j``, ``_x`` (log odds), ``_h`` (step), ``_d``
    (density relative to its mode).  Eight standard deviations and the exponential tails are covered."""
    sd = f"sqrt(1 / {a} + 1 / {b})"
    centre = f"(ln({a}) - ln({b}))"
    g = (df.withColumn("_lo", F.expr(f"{centre} - 8 * {sd} - 30 / {a}"))
         .withColumn("_h", F.expr(f"({centre} + 8 * {sd} + 30 / {b} - _lo) / {points}"))
         .withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(points))))
         .withColumn("_x", F.expr("_lo + _j * _h")))
    # ln p - ln p0 and ln(1 - p) - ln(1 - p0), with p0 = a / (a + b) the mode on this axis
    ld = f"{a} * (-log1p(exp(-_x)) + log1p({b} / {a})) + {b} * (-log1p(exp(_x)) + log1p({a} / {b}))"
    return g.withColumn("_d", F.expr(f"exp({ld})"))


def _cumulated(g: DataFrame, part) -> DataFrame:
    """Normalised density ``_f`` and trapezoid cumulative ``_cdf`` of a grid, both with their value at
    the next point (``_f1``, ``_cdf1``)."""
    order = part.orderBy("_j")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_d").over(part)
    return (g.withColumn("_f", F.col("_d") / (total * F.col("_h")))
            .withColumn("_cdf", (F.sum("_d").over(run) - F.col("_d") / 2) / total)
            .withColumn("_f1", F.lead("_f").over(order)).withColumn("_cdf1", F.lead("_cdf").over(order)))


def prob_b_beats_a(posterior: DataFrame, keys: Sequence[str] = (), a: str = "A", b: str = "B",
                   points: int = GRID_POINTS) -> DataFrame:
    """P(p_B > p_A) for Beta posteriors with any real parameters; NULL when a variant is missing.

    The narrower posterior is summed over its own grid against the cumulative distribution of the
    wider one, read from the wider one's grid by cubic interpolation.  The work per test is fixed
    and does not grow with the number of conversions.
    """
    w = wide_by_variant(posterior, keys, (a, b), ("alpha", "beta"))
    spread = lambda v: F.expr(f"1 / CAST(alpha_{v} AS DOUBLE) + 1 / CAST(beta_{v} AS DOUBLE)")
    fine_is_a = spread(a) <= spread(b)
    pick = lambda c, x, y: F.when(fine_is_a, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).cast("double")
    pairs = w.select(*keys, F.coalesce(fine_is_a, F.lit(False)).alias("_swap"), pick("alpha", a, b).alias("_fa"), pick("beta", a, b).alias("_fb"),
                     pick("alpha", b, a).alias("_wa"), pick("beta", b, a).alias("_wb"))
    part = _part(keys)
    wide = _cumulated(_grid(pairs.select(*keys, "_wa", "_wb"), "_wa", "_wb", points), part)
    wide = wide.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_j").cast("bigint").alias("_at"), F.col("_x").alias("_x0"),
                       F.col("_h").alias("_w"), "_f", "_cdf", "_f1", "_cdf1")
    span = pairs.select(*keys, "_swap", "_fa", "_fb", "_wa", "_wb")
    fine = _grid(span, "_fa", "_fb", points).withColumn("_weight", F.col("_d") / F.sum("_d").over(part)).drop("_lo", "_h", "_j", "_d")
    sd, centre = "sqrt(1 / _wa + 1 / _wb)", "(ln(_wa) - ln(_wb))"
    fine = (fine.withColumn("_wlo", F.expr(f"{centre} - 8 * {sd} - 30 / _wa")).withColumn("_whi", F.expr(f"{centre} + 8 * {sd} + 30 / _wb"))
            .withColumn("_at", F.expr(f"CAST(floor((_x - _wlo) / ((_whi - _wlo) / {points})) AS BIGINT)")))
    on = fine["_at"] == wide["_at"]
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    t = F.expr("(_x - _x0) / _w")
    cubic = (F.col("_cdf") * (2 * t * t * t - 3 * t * t + 1) + F.col("_w") * F.col("_f") * (t * t * t - 2 * t * t + t)
             + F.col("_cdf1") * (3 * t * t - 2 * t * t * t) + F.col("_w") * F.col("_f1") * (t * t * t - t * t))
    below = F.when(F.col("_x") <= F.col("_wlo"), 0.0).when(F.col("_x") >= F.col("_whi"), 1.0).otherwise(F.coalesce(cubic, F.col("_cdf")))
    summed = (fine.join(wide, on, "left").groupBy(*keys, "_swap").agg(F.sum(F.col("_weight") * below).alias("_p")))
    prob = F.when(F.col("_swap"), 1 - F.col("_p")).otherwise(F.col("_p"))
    # least() and greatest() skip NULLs: keep a missing variant NULL
    prob = F.when(prob.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), prob)))
    return summed.select(*keys, F.round(prob, STAT_DP).alias("prob"))


def beta_interval(posterior: DataFrame, level: float = 0.95, points: int = GRID_POINTS,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Equal-tailed credible interval: quantiles of the posterior, interpolated on its own grid."""
    rows = posterior.select(*keys, "variant", F.col("alpha").cast("double").alias("_a"), F.col("beta").cast("double").alias("_b"))
    g = _cumulated(_grid(rows, "_a", "_b", points), _part(keys, "variant"))

    def quantile(q: float):
        here = (F.col("_cdf") <= q) & (F.col("_cdf1") > q)
        x = F.col("_x") + F.col("_h") * (F.lit(q) - F.col("_cdf")) / (F.col("_cdf1") - F.col("_cdf"))
        return F.max(F.when(here, 1 / (1 + F.exp(-x))))
    tail = (1 - level) / 2
    return (g.groupBy(*keys, "variant").agg(quantile(tail).alias("lo"), quantile(1 - tail).alias("hi"))
            .select(*keys, "variant", F.round("lo", INTERVAL_DP).alias("lo"), F.round("hi", INTERVAL_DP).alias("hi")))
