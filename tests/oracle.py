"""Compare a registered query with its SQL, row multiset by row multiset."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def run_spark(df):
    return list(df.columns), rows(df.columns, [tuple(r) for r in df.toLocalIterator()])


def run_sql(con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, rows(names, cur.fetchall())


def difference(names, ours, con, sql) -> str:
    """Empty when equal, otherwise what differs."""
    other_names, theirs = run_sql(con, sql)
    if sorted(names) != sorted(other_names):
        return f"columns {sorted(names)} vs {sorted(other_names)}"
    if ours == theirs:
        return ""
    extra, lacking = ours - theirs, theirs - ours
    return (f"rows {sum(ours.values())} vs {sum(theirs.values())}; "
            f"only spark {sum(extra.values())} e.g. {list(extra)[:2]}; "
            f"only sql {sum(lacking.values())} e.g. {list(lacking)[:2]}")
