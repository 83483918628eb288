"""Holds a query's rows against those of its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in data:
        out.append(tuple(None if (v := r[i]) is None else round(float(v), 3) + 0.0 if isinstance(v, float) else str(v) if not isinstance(v, (int, bool)) else int(v) for i in order))
    return sorted(columns), sorted(out, key=repr)


def compare(df, con, sql):
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    q = con.sql(sql)
    wanted = rows(q.columns, q.fetchall())
    assert found[0] == wanted[0]
    assert len(found[1]) == len(wanted[1])
    assert found[1] == wanted[1]
