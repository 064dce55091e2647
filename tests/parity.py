"""Rows of a query and of its SQL, in a form that compares."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_rows(df):
    names = sorted(df.columns)
    return names, ordered(df.select(*names).collect())


def duck_rows(con, sql):
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    rows = got.fetchall()
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], ordered(tuple(r[i] for i in order) for r in rows)
