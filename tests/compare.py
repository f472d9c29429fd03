"""Row-by-row comparison of a query with its SQL."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def diff(df, sql: str, sf_dir: str) -> str:
    """Empty where both give the same columns and rows."""
    names, theirs = rows_of_sql(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    at = [names.index(c) for c in order]
    key = lambda r: repr(r)
    a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    b = sorted((tuple(plain(r[i]) for i in at) for r in theirs), key=key)
    if a == b:
        return ""
    only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return f"{order}: {len(a)} rows against {len(b)}; only here {only[0]}; only there {only[1]}"
