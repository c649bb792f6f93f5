"""Query registry.  Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame.

Importing the plan modules fills ``QUERIES`` (Spark builders) and ``ORACLE`` (independent
DuckDB SQL over the same tables, used only for checking).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _load() -> None:
    # plan modules register themselves on import
    from splitlens.plans import behaviour, cohorts, etl, experiment, profile, stats  # noqa: F401


_load()
