"""Run queries beside their DuckDB SQL: python -m tests.compare [sf] [name...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(plain(y) for y in x)
    if hasattr(x, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in x.asDict().items()))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    if hasattr(x, "tzinfo") and x.tzinfo is not None:
        return x.replace(tzinfo=None)
    return x


def rows_of(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, sf_dir: str, query, sql: str | None) -> str:
    """What differs, or nothing."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if df.columns else "no columns"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from brontide.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    spark = local_session(8, 8, "12g")
    sf_dir = f"/root/testdata/{sf}"
    con, q, sql = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args and [n for n in q if any(n.startswith(a) for a in args)] or list(q):
        t = time.time()
        try:
            said = difference(spark, con, sf_dir, q[name], sql.get(name))
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(said)
        print(f"{'BAD' if said else 'ok ' if name in sql else 'ran'} {name} {time.time() - t:.1f}s {said}", flush=True)
    print(f"{bad} bad; {len(glob.glob(sf_dir + '/*'))} tables", flush=True)
    os._exit(bool(bad))


if __name__ == "__main__":
    main()
