"""Runs registered queries against DuckDB: ``python tests/compare.py FOLDER [name ...]``."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def plain(value):
    assert not isinstance(value, decimal.Decimal), f"decimal result {value}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(con, sql: str, df) -> str | None:
    """None when equal, else what differs."""
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = rows_of(want_columns, cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(want_columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    if got != want:
        missing = [r for r in want if r not in set(got)][:3]
        extra = [r for r in got if r not in set(want)][:3]
        return f"{len(got)} rows, expected {len(want)}; missing {missing}; extra {extra}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from shoebox.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                problem = check(con, oracles[name], df)
                n = ""
            else:
                problem, n = None, f" rows={len(df.collect())}"
        except Exception as e:  # report every query, then fail
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", ""
        bad += problem is not None
        mark = "FAIL " + problem if problem else ("ok" if name in oracles else "ok (no SQL)" + n)
        print(f"@ {name} {time.time() - start:.1f}s {mark}", flush=True)
    print(f"@ done, {bad} failed")


if __name__ == "__main__":
    main()
