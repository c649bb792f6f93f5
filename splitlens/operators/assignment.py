"""Variant assignment (A1) and the experiment filter (F2).

A unit's variant is a pure function of ``(experiment id, unit id)``:
``conv(substr(md5(exp_id || ':' || unit_id), 1, 7), 16, 10) % n_variants``.  Because it is
an expression, every table that carries the unit id can be tagged with its variant where it
is scanned: no assignment table has to be joined (and shuffled) against the fact rows.
When a real assignment table exists (``experiment_id, unit_id, variant``), use
``from_table`` and join it on the unit id instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlens.pinned import VARIANTS


def bucket_expr(unit: Column | str, exp_id: str | Column) -> Column:
    unit = F.col(unit) if isinstance(unit, str) else unit
    exp = exp_id if isinstance(exp_id, Column) else F.lit(exp_id)
    digest = F.md5(F.concat(exp, F.lit(":"), unit.cast("string")))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint")


def variant_expr(unit: Column | str, exp_id: str | Column,
                 variants: Sequence[str] = VARIANTS) -> Column:
    b = bucket_expr(unit, exp_id)
    if len(variants) == 2:
        # a NULL unit has no variant
        return F.when(b % 2 == 0, F.lit(variants[0])).when(b % 2 == 1, F.lit(variants[1]))
    arr = F.array(*[F.lit(v) for v in variants])
    return F.element_at(arr, (b % len(variants) + 1).cast("int"))


def assign(units: DataFrame, unit_col: str, exp_id: str,
           variants: Sequence[str] = VARIANTS) -> DataFrame:
    """``experiment_id, unit_id, variant`` for every row of ``units``."""
    return units.select(
        F.lit(exp_id).alias("experiment_id"),
        F.col(unit_col).alias("unit_id"),
        variant_expr(F.col(unit_col), exp_id, variants).alias("variant"),
    )


def assignment_table(units: DataFrame, unit_col: str, exp_ids: Sequence[str],
                     variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Assignments of several experiments stacked into one long table."""
    out = None
    for e in exp_ids:
        part = assign(units, unit_col, e, variants)
        out = part if out is None else out.unionByName(part)
    return out


def experiment_filter(assignments: DataFrame, exp_id: str) -> DataFrame:
    """Rows of one experiment.  Catalyst pushes the predicate into every union branch and
    folds away branches whose literal id differs, so only the wanted experiment is scanned."""
    return assignments.filter(F.col("experiment_id") == F.lit(exp_id))


def _per_unit(assignments: DataFrame, exp_id: str) -> DataFrame:
    """One row per unit of the experiment: ``unit_id, n_rows, lo, hi`` (least and greatest variant).  A unit that fills a third
    of the table is combined on the map side."""
    return (experiment_filter(assignments, exp_id).groupBy("unit_id")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("variant").alias("lo"), F.max("variant").alias("hi"),
                 F.count_if(F.col("variant").isNull()).alias("n_null")))


def from_table(assignments: DataFrame, exp_id: str) -> DataFrame:
    """``unit_id, variant`` of a given assignment table, one row per usable unit: repeated rows count once; units in two
    variants, without a variant or without an id belong to no group (``assignment_problems`` reports them)."""
    return (_per_unit(assignments, exp_id).filter("unit_id IS NOT NULL AND lo = hi")
            .select("unit_id", F.col("lo").alias("variant")))


def assignment_problems(assignments: DataFrame, exp_id: str) -> DataFrame:
    """``unit_id, problem, n_rows, variants``: units whose assignment cannot be used (``conflict``: several variants,
    ``no variant``, ``no unit``) and ``repeated`` ones, which count once.  ``variants`` lists the least and greatest."""
    conflict = F.col("lo") < F.col("hi")
    problem = (F.when(F.col("unit_id").isNull(), "no unit").when(F.col("lo").isNull(), "no variant")
               .when(conflict, "conflict").when(F.col("n_rows") > 1, "repeated"))
    return (_per_unit(assignments, exp_id).withColumn("problem", problem).filter(F.col("problem").isNotNull())
            .select("unit_id", "problem", F.col("n_rows").cast("long").alias("n_rows"),
                    F.when(conflict, F.concat_ws(",", "lo", "hi")).otherwise(F.col("lo")).alias("variants")))


def assignment_audit(assignments: DataFrame, exp_id: str) -> DataFrame:
    """``status, units, rows``: the units of the experiment by ``ok`` or kind of problem."""
    problems = assignment_problems(assignments, exp_id).groupBy(F.col("problem").alias("status")).agg(
        F.count(F.lit(1)).alias("units"), F.sum("n_rows").alias("rows"))
    fine = (_per_unit(assignments, exp_id).filter("unit_id IS NOT NULL AND lo = hi AND n_rows = 1")
            .agg(F.lit("ok").alias("status"), F.count(F.lit(1)).alias("units"), F.count(F.lit(1)).alias("rows")))
    return fine.unionByName(problems)
