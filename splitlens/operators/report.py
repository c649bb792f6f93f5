"""Final experiment report table (A7): per segment effect, lift, test and adjusted p."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.functions.numeric import safe_div
from splitlens.operators import multitest as mt
from splitlens.operators import stats as S
from splitlens.pinned import ALPHA, RATE_DP, STAT_DP


def segment_tests(seg_result: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """``segment, cvr_a, cvr_b, lift, z, p_raw`` (two-sided pooled z-test of A - B)."""
    w = S.wide_by_variant(seg_result, ["segment"], (a, b))
    xa, na, xb, nb = (f"converted_{a}", f"units_{a}", f"converted_{b}", f"units_{b}")
    w = S.ztest_two_sample(w, xa, na, xb, nb)
    z, p = F.col("z"), F.col("p_value")
    cvr_a, cvr_b = safe_div(xa, na), safe_div(xb, nb)
    return w.select("segment",
                    F.round(cvr_a, RATE_DP).alias("cvr_a"),
                    F.round(cvr_b, RATE_DP).alias("cvr_b"),
                    F.round(F.try_divide(cvr_b, cvr_a) - 1, RATE_DP).alias("lift"),
                    F.round(z, STAT_DP).alias("z"),
                    p.alias("p_raw"))


def report(seg_result: DataFrame, method: str = "holm_sidak", alpha: float = ALPHA) -> DataFrame:
    """``segment, cvr_a, cvr_b, lift, z, p_value, p_adj, reject``; the family is the set of
    segments of one experiment."""
    t = mt.adjust(segment_tests(seg_result), "p_raw", method, tiebreak=["segment"], alpha=alpha)
    return t.select("segment", "cvr_a", "cvr_b", "lift", "z",
                    F.round("p_raw", STAT_DP).alias("p_value"), "p_adj", "reject")


def family_adjusted(seg_result: DataFrame, method: str, alpha: float = ALPHA) -> DataFrame:
    """``segment, p_value, p_adj, reject`` for one correction method."""
    t = mt.adjust(segment_tests(seg_result), "p_raw", method, tiebreak=["segment"], alpha=alpha)
    return t.select("segment", F.round("p_raw", STAT_DP).alias("p_value"), "p_adj", "reject")
