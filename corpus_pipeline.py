"""A cleaning pipeline over ``documents``: each stage works on all rows the stage before kept.

Rows with null texts or ids pass every stage that has nothing against them, repeated rows are judged alike, an empty table gives
an empty result, and columns beside doc_id and text are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitlens.llm import decontam, jaccard_join, mixing, pii, toxicity
from splitlens.llm.common import table
from splitlens.session import drop_written, scratch, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go; null and empty texts stay."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays; rows without an id or words stay."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the words that give it away are replaced in the texts; no row goes."""
    return pii.sanitise(docs)


def rate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates that bring the token shares of the domains to their targets; no row goes."""
    return mixing.mixing_rates(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("pii", hide_personal_data),
    ("mixing", rate_documents),
]

# classifiers and least squares have no SQL form; the tests compare the rows that near copies and benchmark items cost, and the
# texts after PII, with brute force on each stage's own input
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage writes for itself is deleted when its documents are written, and these when
    the next stage's are."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.mode("overwrite").parquet(path)
        if before is not None:
            drop_written(before)
        docs = before = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
