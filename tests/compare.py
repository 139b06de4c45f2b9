"""Run registered queries and their SQL twins side by side.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return "\0" if v is None else str(v)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def table(columns, kinds, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], [kinds[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def run_spark(fn, spark, sf_dir):
    df = fn(spark, sf_dir)
    return table(df.columns, [KINDS.get(k, k) for _, k in df.dtypes], [tuple(r) for r in df.collect()])


def run_sql(con, text):
    cur = con.execute(text)
    return table([c[0] for c in cur.description], [str(c[1]) for c in cur.description], cur.fetchall())


def difference(ours, theirs) -> str | None:
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} vs {theirs[0]}"
    if len(ours[2]) != len(theirs[2]):
        return f"rows {len(ours[2])} vs {len(theirs[2])}"
    if ours[1] != theirs[1]:
        return f"types {[t for t in zip(ours[0], ours[1], theirs[1]) if t[1] != t[2]]}"
    bad = [(a, b) for a, b in zip(ours[2], theirs[2]) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    import __spark_entry__ as contract
    from greenledger.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else SF
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.ui.showConsoleProgress": "false",
                                                    "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql, failed = connect(sf_dir), contract.queries(), contract.oracle_sql(), 0
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            ours = run_spark(fn, spark, sf_dir)
            took = time.time() - start
            problem = difference(ours, run_sql(con, sql[name])) if name in sql else None
            note = problem or ("ok" if name in sql else "no oracle")
            note += f"  [{len(ours[2])} rows]" + ("" if name in sql else f" {ours[2][:3]}")
        except Exception as error:  # noqa: BLE001
            took, problem = time.time() - start, True
            note = f"{type(error).__name__} {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'pass'} {name:40s} {took:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main()))
