"""Special functions as Spark SQL expressions (no UDFs).

Spark SQL has neither ``erf`` nor ``lgamma``.  The p-values of the chi-square and normal
tests come from the regularised lower incomplete gamma function evaluated by its power
series inside a higher-order ``aggregate``; ``ln Gamma`` is a shifted Stirling series.

The kernels are generated as SQL text over column names (``*_sql``) and wrapped once with
``F.expr``: a single parse in the JVM instead of thousands of Python-side Column calls.
They run on already-aggregated rows (one row per test), so their per-row cost is
irrelevant at scale.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LN_2PI = repr(0.5 * math.log(2.0 * math.pi))


def _s(x) -> str:
    """SQL text of an argument: a column name / SQL expression, or a number."""
    if isinstance(x, bool):
        raise TypeError("boolean argument")
    if isinstance(x, (int, float)):
        return f"CAST({x!r} AS DOUBLE)"
    if isinstance(x, str):
        return f"({x})"
    raise TypeError("kernel arguments are column names / SQL text or numbers")


# ---------------------------------------------------------------- SQL text
def ln_gamma_sql(z) -> str:
    """ln Gamma(z), z > 0: Stirling series at w = z + 8 minus ln(z (z+1) ... (z+7))."""
    z = f"CAST({_s(z)} AS DOUBLE)"
    w = f"({z} + 8.0D)"
    return (f"(({w} - 0.5D) * ln({w}) - {w} + {_HALF_LN_2PI}D"
            f" + 1.0D / (12.0D * {w}) - 1.0D / (360.0D * power({w}, 3))"
            f" + 1.0D / (1260.0D * power({w}, 5)) - 1.0D / (1680.0D * power({w}, 7))"
            f" - ln({z} * ({z} + 1) * ({z} + 2) * ({z} + 3))"
            f" - ln(({z} + 4) * ({z} + 5) * ({z} + 6) * ({z} + 7)))")


def ln_beta_sql(a, b) -> str:
    return f"({ln_gamma_sql(a)} + {ln_gamma_sql(b)} - {ln_gamma_sql(f'{_s(a)} + {_s(b)}')})"


def gamma_p_sql(a, x) -> str:
    """Regularised lower incomplete gamma P(a, x) = sum_n exp((a + n) ln x - x - ln Gamma(a + n + 1)).

    Every term is at most 1 and the largest stands at n = x - a; the sum runs over that place and
    12 standard deviations on either side, however large the arguments are."""
    a = f"CAST({_s(a)} AS DOUBLE)"
    x = f"CAST({_s(x)} AS DOUBLE)"
    reach = f"(12.0D * sqrt(greatest({a}, {x})) + 60.0D)"
    first = f"CAST(greatest(0.0D, floor({x} - {a}) - {reach}) AS BIGINT)"
    last = f"CAST(greatest(0.0D, floor({x} - {a})) + {reach} AS BIGINT)"
    term = f"exp(({a} + n) * ln({x}) - {x} - {ln_gamma_sql(f'{a} + n + 1.0D')})"
    series = f"aggregate(sequence({first}, {last}), 0.0D, (acc, n) -> acc + {term})"
    return (f"(CASE WHEN {x} IS NULL OR {a} IS NULL THEN CAST(NULL AS DOUBLE) "
            f"WHEN {x} <= 0 THEN 0.0D ELSE least(1.0D, {series}) END)")


def chi2_sf_sql(stat, dof) -> str:
    """Upper tail of chi-square(dof) at stat: 1 - P(dof/2, stat/2)."""
    st, d = _s(stat), _s(dof)
    return (f"(CASE WHEN {st} IS NULL OR {d} IS NULL OR {d} <= 0 THEN CAST(NULL AS DOUBLE) "
            f"ELSE 1.0D - {gamma_p_sql(f'{d} / 2.0D', f'{st} / 2.0D')} END)")


def norm_p2_sql(z) -> str:
    """Two-sided normal p-value 2 (1 - Phi(|z|)) = chi-square(1) tail at z^2."""
    z = _s(z)
    return chi2_sf_sql(f"{z} * {z}", 1)


def norm_sf_sql(z) -> str:
    """Upper one-sided 1 - Phi(z)."""
    z = _s(z)
    half = f"({norm_p2_sql(z)} / 2.0D)"
    return f"(CASE WHEN {z} >= 0 THEN {half} ELSE 1.0D - {half} END)"


def norm_cdf_sql(z) -> str:
    return f"(1.0D - {norm_sf_sql(z)})"


_EULER_GAMMA = "0.5772156649015329D"


def harmonic_sql(m) -> str:
    """H(m) = digamma(m + 1) + gamma: the asymptotic series at m + 20 less the twenty terms it
    runs ahead, one formula at every size."""
    m = f"CAST({_s(m)} AS DOUBLE)"
    w = f"({m} + 20.0D)"
    ahead = " + ".join(f"1.0D / ({m} + {k})" for k in range(1, 21))
    return (f"(ln({w}) + {_EULER_GAMMA} + 1.0D / (2.0D * {w}) - 1.0D / (12.0D * {w} * {w})"
            f" + 1.0D / (120.0D * power({w}, 4)) - 1.0D / (252.0D * power({w}, 6))"
            f" + 1.0D / (240.0D * power({w}, 8)) - ({ahead}))")


# ---------------------------------------------------------------- Column wrappers
def ln_gamma(z) -> Column:
    return F.expr(ln_gamma_sql(z))


def ln_beta(a, b) -> Column:
    return F.expr(ln_beta_sql(a, b))


def gamma_p(a, x) -> Column:
    return F.expr(gamma_p_sql(a, x))


def chi2_sf(stat, dof) -> Column:
    return F.expr(chi2_sf_sql(stat, dof))


def norm_two_sided_p(z) -> Column:
    return F.expr(norm_p2_sql(z))


def norm_sf(z) -> Column:
    return F.expr(norm_sf_sql(z))


def norm_cdf(z) -> Column:
    return F.expr(norm_cdf_sql(z))


def harmonic(m) -> Column:
    return F.expr(harmonic_sql(m))


def _col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def safe_div(num, den) -> Column:
    """NULL instead of an error (ANSI mode) when the denominator is 0 or NULL.
    Strings are column names here."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))
