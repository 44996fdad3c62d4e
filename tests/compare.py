"""Compare queries with their SQL in DuckDB: column names, row counts and values as a multiset."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def multiset(columns: list[str], rows: list) -> Counter:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(r[i]).__name__, r[i]) for i in at) for r in rows)


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> str | None:
    """None if both agree, else what differs."""
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if rows else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}"
    if not rows:
        return "no rows"
    a, b = multiset(df.columns, rows), multiset(names, want)
    if a != b:
        return f"values differ in {sum((a - b).values())} rows: {list((a - b))[:2]} vs {list((b - a))[:2]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tallywire.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf)
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            why = compare(spark, con, sf, fn, entry.oracle_sql().get(name))
        except Exception as e:  # noqa: BLE001 - a report of all failures is wanted
            why = f"{type(e).__name__}: {str(e)[:600]}"
        bad += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {time.time() - t:.2f}s {why or ''}", flush=True)
    print("failures", bad)
