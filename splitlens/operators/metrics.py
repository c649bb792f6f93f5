"""Metric registry (N20): metric name -> aggregate expression, applied to any grouping.

Metrics are factories of ``Column`` aggregates, so one definition serves every report.
``long_form`` evaluates all metrics for several single-column groupings in one pass with
GROUPING SETS and returns ``dim, dim_value, metric, value``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlens.pinned import MONEY, RATE_DP

MetricFactory = Callable[[], Column]

# Typed aggregates (counts BIGINT, money DECIMAL); the long form casts to DOUBLE at the end.
REGISTRY: dict[str, MetricFactory] = {
    "orders": lambda: F.count(F.lit(1)),
    "revenue": lambda: F.sum(F.col("o_totalprice").cast(MONEY)),
    "avg_order_value": lambda: F.round(F.avg("o_totalprice"), RATE_DP),
}


def register(name: str, factory: MetricFactory) -> None:
    REGISTRY[name] = factory


def aggregate(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide form: one column per metric."""
    return df.groupBy(*keys).agg(*[REGISTRY[m]().alias(m) for m in metrics])


def long_form(df: DataFrame, dims: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    g = (df.groupingSets([[d] for d in dims], *dims)
         .agg(*[REGISTRY[m]().alias(m) for m in metrics],
              *[F.grouping(d).alias(f"_g_{d}") for d in dims]))
    dim = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dims])
    val = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")) for d in dims])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"),
                               F.round(F.col(m).cast("double"), RATE_DP).alias("value"))
                      for m in metrics])
    return (g.select(dim.alias("dim"), val.alias("dim_value"), F.explode(cells).alias("c"))
            .select("dim", "dim_value", "c.metric", "c.value"))
