"""Run registered queries beside their DuckDB checks.

    python -m tests.compare [scale] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
ROOT = os.environ.get("TESTDATA", "/root/testdata")


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def differences(df, con, sql: str) -> str | None:
    described = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    wrong = {c: (t, described.get(c)) for c, t in df.dtypes if TYPES.get(t) != described.get(c)}
    if wrong:
        return f"types differ: {wrong}"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want = normal(names, result.fetchall())
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"spark {str(a)[:600]}\n    duck {str(b)[:600]}"
    return None if got else "no rows on either side"


def main() -> None:
    from packloom.catalog import ORACLES, QUERIES, Tables
    from packloom.session import local_session

    args = sys.argv[1:]
    scale = args[0] if args else "sf0.001"
    spark = local_session(8)
    folder = f"{ROOT}/{scale}"
    con = duck(folder)
    bad = 0
    for name in args[1:] or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](Tables(spark, folder))
            if name in ORACLES:
                verdict = differences(df, con, ORACLES[name])
            else:
                verdict = None if df.collect() else "no rows"
        except Exception as exc:
            verdict = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += verdict is not None
        print(f"{'ok ' if verdict is None else 'BAD'} {name} {time.time() - start:.1f}s {verdict or ''}", flush=True)
    print(f"{bad} bad of {len(args[1:] or QUERIES)}; oracles {len(ORACLES)} of {len(QUERIES)}")


if __name__ == "__main__":
    main()
