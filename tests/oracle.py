"""Run one registered query on both engines and compare rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def multiset(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> tuple[str | None, int]:
    """What differs (None when equal) and the number of rows."""
    result = con.execute(sql)
    theirs_cols = [d[0] for d in result.description]
    theirs_rows = result.fetchall()
    if sorted(df.columns) != sorted(theirs_cols):
        return f"columns {sorted(df.columns)} != {sorted(theirs_cols)}", 0
    ours, theirs = multiset(df.columns, df.collect()), multiset(theirs_cols, theirs_rows)
    if ours == theirs:
        return None, sum(ours.values())
    return (f"rows {sum(ours.values())} vs {sum(theirs.values())}; only ours {list((ours - theirs).items())[:3]}; "
            f"only theirs {list((theirs - ours).items())[:3]}"), sum(ours.values())
