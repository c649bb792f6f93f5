"""Registered plans: one DataFrame builder per query key, plus its DuckDB oracle SQL."""

from splitlens.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
