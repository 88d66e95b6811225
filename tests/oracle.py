"""Compares registered queries with their SQL in DuckDB: python tests/oracle.py [--sf 0.01] [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {f.stem} as select * from '{f if f.is_file() else f'{f}/*.parquet'}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows_of(cursor_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cursor_rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """None if they agree, else what differs."""
    df = query(spark, sf_dir)
    ours = rows_of([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    theirs = rows_of(cur.fetchall(), [d[0] for d in cur.description])
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] != theirs[1]:
        a, b = set(map(repr, ours[1])), set(map(repr, theirs[1]))
        return f"{len(ours[1])} and {len(theirs[1])} rows; only Spark: {sorted(a - b)[:3]}; only SQL: {sorted(b - a)[:3]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from quillon.session import local_session

    args = sys.argv[1:]
    sf = args.pop(args.index("--sf") + 1) if "--sf" in args else "0.01"
    names = [a for a in args if a != "--sf"]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if (names and not any(name.startswith(n) for n in names)) or name not in sqls:
            continue
        t = time.time()
        try:
            why = compare(spark, con, name, query, sqls[name], sf_dir)
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:600]}"
        bad += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {time.time() - t:.1f}s {why or ''}", flush=True)
    sys.exit(bad > 0)
