"""Compares a query with its SQL in DuckDB, as bags of rows."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(r[i] for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = bag([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1], ((got[1] - want[1]).most_common(3), (want[1] - got[1]).most_common(3))
    return sum(got[1].values())
