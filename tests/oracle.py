"""Compares a query's rows with those of its SQL."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(f"{sf_dir}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    out = con.execute(sql)
    return [c[0] for c in out.description], out.fetchall()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def compare(df, sf_dir: str, sql: str) -> str:
    """Empty if both have the same columns and rows, in any order; else what differs."""
    names, rows = sql_rows(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    key = lambda r: tuple((v is None, str(type(v)), str(v)) for v in r)
    got = sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in rows), key=key)
    if got == want:
        return ""
    first = next(((g, w) for g, w in zip(got, want) if g != w), None)
    return f"{len(got)} and {len(want)} rows; first difference {first} in {order}"
