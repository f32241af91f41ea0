"""Holds registered queries against their SQL, rows in any order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


def same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    out = con.execute(sql)
    place = {d[0]: i for i, d in enumerate(out.description)}
    assert sorted(place) == names
    want = sorted(repr([plain(r[place[c]]) for c in names]) for r in out.fetchall())
    assert got == want
