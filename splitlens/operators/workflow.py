"""The whole experiment analysis as one DAG (assignment -> unit metrics -> results -> tests
-> correction -> report).

The per-variant and per-segment results are read by every test, so they are persisted once
(they hold one row per variant / segment x variant; ``MEMORY_AND_DISK`` and recomputable
from lineage if an executor is lost) instead of re-scanning the fact table for each output.
"""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlens.operators import report as rep
from splitlens.operators import results as res
from splitlens.operators import stats as S
from splitlens.pinned import ALPHA, ONE_SAMPLE_NULL, STAT_DP


def analyze_experiment(spark: SparkSession, customer: DataFrame, orders: DataFrame, exp_id: str,
                       start: dt.date, end: dt.date, method: str = "holm_sidak",
                       alpha: float = ALPHA, assignments: DataFrame | None = None
                       ) -> dict[str, DataFrame]:
    """All outputs of one experiment, keyed like the registered queries."""
    total = res.result_total(customer, orders, exp_id, start, end,
                             assignments=assignments).persist(StorageLevel.MEMORY_AND_DISK)
    segments = res.segment_result(customer, orders, exp_id, start, end,
                                  assignments=assignments).persist(StorageLevel.MEMORY_AND_DISK)
    wide = S.wide_by_variant(total)
    post = S.beta_posterior(total)
    cells = S.contingency(total)

    def rounded(df: DataFrame) -> DataFrame:
        return df.select(F.round("z", STAT_DP).alias("z"), F.round("p_value", STAT_DP).alias("p_value"))

    return {
        "ab_result_total": total,
        "ab_result_daily": res.result_daily(spark, customer, orders, exp_id, start, end,
                                            assignments=assignments),
        "contingency": cells,
        "chi2_2x2": S.chi2_test(cells, "variant", "outcome"),
        "chi2_rxc": S.chi2_test(segments, "variant", "segment", "converted"),
        "ztest_two_sample": rounded(S.ztest_two_sample(wide, "converted_A", "units_A",
                                                       "converted_B", "units_B")),
        "ztest_one_sample": rounded(S.ztest_one_sample(wide, "converted_B", "units_B",
                                                       ONE_SAMPLE_NULL)),
        "ztest_one_sided": rounded(S.ztest_two_sample(wide, "converted_B", "units_B",
                                                      "converted_A", "units_A", "larger")),
        "beta_posterior": post,
        "beta_prob_b_beats_a": S.prob_b_beats_a(post),
        "beta_interval": S.beta_interval(post),
        "ab_report": rep.report(segments, method, alpha),
    }
