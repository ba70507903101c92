"""Compare a query with its DuckDB SQL: names, row count and values, in any order of rows."""

from __future__ import annotations

import math
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    return str(v)


def differences(spark, sf_dir: str, query, sql: str, con) -> str:
    df = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    return next((f"{a} and {b}" for a, b in zip(mine, theirs, strict=True) if a != b), "")
