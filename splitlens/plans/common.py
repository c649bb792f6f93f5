"""Shared SQL fragments for the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from splitlens.pinned import EXP_ID, WINDOW_END, WINDOW_START


def duck_variant(unit_sql: str, exp_id: str = EXP_ID) -> str:
    return (f"CASE WHEN {unit_sql} IS NULL THEN NULL WHEN ('0x' || substr(md5('{exp_id}:' || CAST({unit_sql} AS VARCHAR)), 1, 7))"
            f"::BIGINT % 2 = 0 THEN 'A' ELSE 'B' END")


W_START = f"TIMESTAMP '{WINDOW_START.isoformat()} 00:00:00'"
W_END_EXCL = f"(TIMESTAMP '{WINDOW_END.isoformat()} 00:00:00' + INTERVAL 1 DAY)"
IN_WINDOW = f"o_orderdate >= {W_START} AND o_orderdate < {W_END_EXCL}"


def duck_chi2_sf(x: str, dof: str) -> str:
    """Upper chi-square tail via lgamma and a summed series around its largest term:
    P(a,y) = sum_n exp((a+n) ln y - y - lgamma(a+n+1))."""
    a = f"(({dof}) / 2.0)"
    y = f"(({x}) / 2.0)"
    reach = f"(14 * sqrt(greatest({a}, {y})) + 80)"
    series = (f"list_sum(list_transform(range(CAST(greatest(0, floor({y} - {a}) - {reach}) AS BIGINT), "
              f"CAST(greatest(0, floor({y} - {a})) + {reach} AS BIGINT)), lambda n: "
              f"exp(({a} + n) * ln({y}) - {y} - lgamma({a} + n + 1))))")
    return (f"(CASE WHEN ({x}) IS NULL OR ({dof}) IS NULL THEN NULL "
            f"WHEN ({x}) <= 0 THEN 1.0 "
            f"ELSE 1.0 - least(1.0, {series}) END)")


def duck_norm_p2(z: str) -> str:
    return duck_chi2_sf(f"(({z}) * ({z}))", "1")
