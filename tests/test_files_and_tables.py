"""Text files that split and lose nothing; delivered assignment tables with faults."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from splitlens.operators import assignment as A
from splitlens.operators import profile as P
from splitlens.operators import results as res
from splitlens.operators import selection as S
from splitlens.session import ensure_checkpoint_dir, scratch
from splitlens.sources import files

AWKWARD = ["plain", "", " padded ", "\\N", "\\\\N", "N", None, 'say "hi", ok', "tab\there", "two\nlines", "cr\rlf\r\n", "\\n", "\\\\", "\\", "a\\\\nb\\\r\n\\r", ",", "é \u0085x"]


def test_awkward_strings_survive(spark, tmp_path):
    rows = [(i, s, AWKWARD[-1 - i]) for i, s in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    for sep in (",", "\t"):
        path = files.write_csv(df.coalesce(1), str(tmp_path / f"t{ord(sep)}"), sep)
        back = files.read_csv(spark, path, df.schema, sep)
        assert sorted(map(tuple, back.collect())) == rows
        assert back.filter("a IS NULL").count() == 1 and back.select("b").count() == len(rows)


def test_other_types_survive(spark, tmp_path):
    kinds = T.StructType([*files.EVENTS_SCHEMA.fields, T.StructField("d", T.DateType()), T.StructField("m", T.DecimalType(18, 2))])
    rows = [(1, dt.datetime(2024, 1, 2, 3, 4, 5, 678901), None, "a", 1.5e-9, '{"k": "x\ny"}', dt.date(2024, 2, 29), None), (None,) * 8]
    df = spark.createDataFrame(rows, kinds)
    back = files.read_csv(spark, files.write_csv(df, str(tmp_path / "e")), kinds)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id", "concat('line\\n', id, repeat('x', 40)) AS s")
    path = files.write_csv(df.coalesce(1), str(tmp_path / "big"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        back = files.read_csv(spark, path, df.schema)
        assert back.rdd.getNumPartitions() > 4
        assert back.exceptAll(df).count() == 0 and back.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_faults_of_an_assignment_table(spark):
    rows = [("e", 1, "A"), ("e", 2, "B"), ("e", 2, "B"), ("e", 3, "A"), ("e", 3, "B"), ("e", 3, "A"), ("e", 4, None), ("e", None, "A"),
            ("e", 5, "B"), ("e", 5, None), ("other", 1, "B"), (None, 9, "A")]
    table = spark.createDataFrame(rows, "experiment_id string, unit_id long, variant string")
    assert sorted(map(tuple, A.from_table(table, "e").collect())) == [(1, "A"), (2, "B"), (5, "B")]
    got = sorted(map(tuple, A.assignment_problems(table, "e").collect()), key=str)
    assert got == sorted([(2, "repeated", 2, "B"), (3, "conflict", 3, "A,B"), (4, "no variant", 1, None), (None, "no unit", 1, "A"), (5, "repeated", 2, "B")], key=str)
    audit = {r["status"]: (r["units"], r["rows"]) for r in A.assignment_audit(table, "e").collect()}
    assert audit == {"ok": (1, 1), "repeated": (2, 4), "conflict": (1, 3), "no variant": (1, 1), "no unit": (1, 1)}
    assert A.assignment_problems(table.limit(0), "e").count() == 0


def test_faulty_units_are_not_counted_twice(spark):
    units = spark.createDataFrame([(i,) for i in range(1, 7)], "c_custkey long")
    orders = spark.createDataFrame([(i, i, 10.0, dt.datetime(2024, 1, 2)) for i in range(1, 7)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz")
    table = spark.createDataFrame([("e", i, "A" if i < 4 else "B") for i in range(1, 7)] * 3 + [("e", 6, "A")], "experiment_id string, unit_id long, variant string")
    got = res.result_total(units, orders, "e", dt.date(2024, 1, 1), dt.date(2024, 1, 31), assignments=A.from_table(table, "e"))
    assert sorted((r["variant"], r["units"], r["orders"]) for r in got.collect()) == [("A", 3, 3), ("B", 2, 2)]


def _tables(spark):
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark) + "/splitlens-tables")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    return {str(f.getPath()) for f in fs.listStatus(path)} if fs.exists(path) else set()


def test_written_tables_do_not_pile_up(spark):
    df = spark.range(500).selectExpr("CAST(id % 3 AS STRING) AS g", "id * id % 97 AS v", "id")
    before = _tables(spark)
    with scratch(spark):
        rows = P.box_stats(df, "v", "g").collect()
        files.roundtrip_parquet(spark, df, "copy").count()
    assert len(rows) == 3 and _tables(spark) == before
    with scratch(spark):      # an inner block ends without the outer one's tables
        kept = files.roundtrip_parquet(spark, df, "kept")
        with scratch(spark):
            files.roundtrip_parquet(spark, df, "gone").count()
        assert kept.count() == 500
    assert _tables(spark) == before
    assert len(P.box_stats(df, "v", "g").collect()) == 3 and _tables(spark) == before      # the state of few groups is not written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(S, "FEW_STATE", 1)
        assert len(P.box_stats(df, "v", "g").collect()) == 3
    assert len(_tables(spark) - before) <= 2      # the last state of the selection and the boxes, whatever the passes
