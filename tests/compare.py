"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(_cell, v))
    if hasattr(v, "tolist"):
        return tuple(map(_cell, v.tolist()))
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(r[n]) for n in names) for r in df.collect()), key=repr)


def compare(df, con, sql: str) -> str:
    """'' if equal, else what differs."""
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    names, got = rows_of(df)
    if sorted(cols) != names:
        return f"columns {names} != {sorted(cols)}"
    at = [cols.index(n) for n in names]
    want = sorted((tuple(_cell(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; only spark {[r for r in got if r not in set(want)][:3]}; only sql {[r for r in want if r not in set(got)][:3]}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"{names}\n  spark {g}\n  sql   {w}"
    return ""
