"""Side-by-side check of a registered Spark plan against its DuckDB oracle SQL.

Usage: python -m tests.harness /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from splitlens.sources.tables import TABLES


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return v.item()
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, round(x, 6)) if isinstance(x, float)
                 else (2, str(x)) for x in row)


def _close(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, bool) or isinstance(b, bool):
        return bool(a) == bool(b)
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
    return str(a) == str(b)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(_norm(r[i]) for i in order) for r in records], [columns[i] for i in order]


def compare(spark, con, key: str, sf_dir: str, builder, sql: str | None):
    t0 = time.time()
    sdf = builder(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    t_spark = time.time() - t0
    if sql is None:
        return {"key": key, "ok": None, "rows": len(s_rows), "spark_s": round(t_spark, 2),
                "note": "no oracle"}
    d = con.sql(sql)
    d_cols = list(d.columns)
    d_rows = d.fetchall()
    s_norm, s_c = rows_of(s_cols, s_rows)
    d_norm, d_c = rows_of(d_cols, d_rows)
    out = {"key": key, "rows": len(s_rows), "oracle_rows": len(d_rows),
           "spark_s": round(t_spark, 2)}
    if s_c != d_c:
        out.update(ok=False, note=f"columns differ: spark={s_c} oracle={d_c}")
        return out
    if len(s_rows) != len(d_rows):
        out.update(ok=False, note="row counts differ")
        return out
    s_sorted = sorted(s_norm, key=_key)
    d_sorted = sorted(d_norm, key=_key)
    for a, b in zip(s_sorted, d_sorted):
        if not all(_close(x, y) for x, y in zip(a, b)):
            out.update(ok=False, note=f"value mismatch: spark={a} oracle={b}")
            return out
    out["ok"] = True
    return out


def main(argv):
    from splitlens.plans import ORACLE, QUERIES
    from splitlens.session import get_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or list(QUERIES)
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck_connection(sf_dir)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, con, k, sf_dir, QUERIES[k], ORACLE.get(k))
        except Exception as e:  # report and continue
            r = {"key": k, "ok": False, "note": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} not failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
