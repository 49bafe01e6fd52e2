"""Spark rows against DuckDB's."""

import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(sf, sql):
    with duckdb.connect() as c:
        for f in glob.glob(f"{sf}/*.parquet"):
            c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
        r = c.execute(sql)
        return [d[0] for d in r.description], r.fetchall()


def difference(df, sf, sql):
    """None, or what differs."""
    names, want = oracle(sf, sql)
    got = df.collect()
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        x, y = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only here {x}; only there {y}"
    return None
