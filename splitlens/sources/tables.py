"""Table access.

``sql_read`` is the Spark form of "run a warehouse query into a DataFrame": SQL text with
typed named parameters (``:start``) instead of quoting values into the text, evaluated by
Catalyst against registered views or DataFrames passed by name.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


_READS: dict[tuple[str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, refresh: bool = False) -> DataFrame:
    """Parquet table ``<sf_dir>/<name>.parquet``.

    The DataFrame (and with it the file listing and footer schema) is reused within a
    session; pass ``refresh=True`` after the files changed."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark._jsparkSession.sessionUUID(), path)
    if refresh or key not in _READS:
        _READS[key] = spark.read.parquet(path)
    return _READS[key]


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def sql_read(spark: SparkSession, query: str, args: dict[str, Any] | None = None,
             **frames: DataFrame) -> DataFrame:
    """Run ``query`` with typed named parameters.

    ``frames`` are referenced in the text as ``{name}``; views registered in the session
    are referenced by plain name.  Values in ``args`` are bound as typed literals
    (``datetime.date`` stays a DATE), so no value is ever spliced into the SQL text.
    """
    return spark.sql(query, args=args or None, **frames)


def warehouse_read(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Run ``query`` on a remote SQL warehouse over JDBC and return the result as a DataFrame.

    Spark pushes the whole query to the warehouse (``query`` option) and reads the result in
    ``numPartitions`` parallel slices when ``partitionColumn`` / bounds are given.  Needs the
    warehouse's JDBC driver on the classpath; credentials go in ``options`` (``user``,
    ``password`` or driver-specific keys), never in the SQL text.
    """
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
