"""Run registered queries beside their DuckDB twin: python tests/check_queries.py [sf_dir] [name-part ...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from vecrec import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "item") and getattr(v, "ndim", 0) == 0:
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v) if not isinstance(v, int) else v


def rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted([tuple(plain(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)], key=repr)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(duck_pdf.columns)}"
    a, b = rows(spark_pdf), rows(duck_pdf)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; spark only {[x for x in a if x not in b][:2]}; duck only {[x for x in b if x not in a][:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}"
    for c in spark_pdf.columns:
        ka, kb = spark_pdf[c].dtype.kind, duck_pdf[c].dtype.kind
        if ka != kb and len(a):
            return f"dtype of {c}: {spark_pdf[c].dtype} != {duck_pdf[c].dtype}"
    return ""


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        try:
            got = fn(spark, sf).toPandas()
            took = time.time() - t
            if name in oracles:
                problem = compare(got, con.execute(oracles[name]).df())
            else:
                problem = "" if len(got) else "no rows"
        except Exception as exc:  # report and go on
            took, got, problem = time.time() - t, [], f"{type(exc).__name__}: {str(exc)[:600]}"
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {name:40} {kind:4} n={len(got):6} {took:6.2f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
