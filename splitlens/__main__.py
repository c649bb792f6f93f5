"""Command line: list the registered queries, or run one against a folder of Parquet tables.

    python -m splitlens list
    python -m splitlens run ab_result_total --data /path/to/tables [--show 20] [--out path --format parquet|csv]
"""

from __future__ import annotations

import argparse
import sys

from splitlens.plans import ORACLE, QUERIES
from splitlens.session import get_session, scratch


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="splitlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="registered query keys")
    run = sub.add_parser("run", help="run one query")
    run.add_argument("key", choices=sorted(QUERIES))
    run.add_argument("--data", required=True, help="folder with <table>.parquet files")
    run.add_argument("--master", default=None, help="e.g. local[8]; default: from spark-submit")
    run.add_argument("--show", type=int, default=20, help="rows to print (0: none)")
    run.add_argument("--out", default=None, help="write the full result here")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    args = ap.parse_args(argv)

    if args.cmd == "list":
        for k in sorted(QUERIES):
            print(k, "(oracle)" if k in ORACLE else "")
        return 0

    spark = get_session(args.master)
    with scratch(spark):
        df = QUERIES[args.key](spark, args.data)
        if args.out:
            w = df.write.mode("overwrite")
            (w.option("header", True).csv(args.out) if args.format == "csv" else w.parquet(args.out))
        if args.show:
            df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
