"""File sinks and sources: raw CSV logs, Parquet summaries and tab-separated exports.

Writes go to a folder under the shared checkpoint location (see ``session.shared_dir``),
never to a machine-local temp folder, so executors on any host can read them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitlens.session import shared_dir

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


# Every record is one line, so files split between tasks: inside strings a backslash, line feed and carriage return
# are written as the two characters on the right (in this order), and NULL as the mark no encoded string can equal.
_ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"))
_NULL = "\\N"
_FORMAT = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": _NULL,
           "emptyValue": "", "escape": '"', "quoteAll": "true", "lineSep": "\n"}


def _strings(schema: T.StructType) -> set[str]:
    return {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}


def _encoded(name: str) -> Column:
    c = F.col(name)
    for plain, mark in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c.alias(name)


def _decoded(name: str) -> Column:
    """Undo ``_encoded``: the pieces between doubled backslashes hold no other escaped backslash."""
    def plain(piece: Column) -> Column:
        for raw, mark in _ESCAPES[1:]:
            piece = F.replace(piece, F.lit(mark), F.lit(raw))
        return piece

    pieces = F.split(F.col(name), r"\\\\", -1)
    return F.when(F.instr(F.col(name), "\\") == 0, F.col(name)).otherwise(F.array_join(F.transform(pieces, plain), "\\")).alias(name)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """Delimited text with a header; strings are encoded so that ``read_csv`` gives back what was written."""
    strings = _strings(df.schema)
    (df.select(*[_encoded(c) if c in strings else F.col(c) for c in df.columns])
       .write.mode("overwrite").options(**_FORMAT).option("header", True).option("sep", sep)
       .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
       .csv(path))
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Read delimited text of ``write_csv`` with a declared schema (no inference pass over the data); a file is split
    between tasks at line breaks."""
    raw = (spark.read.schema(schema).options(**_FORMAT).option("header", True).option("sep", sep)
           .option("mode", "FAILFAST").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
           .csv(path))
    strings = _strings(schema)
    return raw.select(*[_decoded(c) if c in strings else F.col(c) for c in raw.columns])


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def export_tsv(df: DataFrame, path: str) -> str:
    """Tab-separated export with a header and no index column."""
    return write_csv(df, path, sep="\t")


def roundtrip_csv(spark: SparkSession, df: DataFrame, schema: T.StructType, name: str,
                  sep: str = ",") -> DataFrame:
    path = write_csv(df, shared_dir(spark, name), sep=sep)
    return read_csv(spark, path, schema, sep=sep)


def roundtrip_parquet(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = write_parquet(df, shared_dir(spark, name))
    return spark.read.parquet(path)
