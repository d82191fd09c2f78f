"""Compare a query with its SQL on DuckDB: rows as sorted lists, columns by name, numbers to five places."""

import datetime
import decimal
import os

import duckdb


def plain(x):
    if x is None or isinstance(x, str):
        return x
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, bool) or isinstance(x, int):
        return int(x) if not isinstance(x, bool) else x
    if isinstance(x, float):
        return None if x != x else int(x) if x == int(x) and abs(x) < 1e15 else round(x, 5)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    return str(x)


def tables(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    ours = [plain(list(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = [plain([r[i] for i in at]) for r in found.fetchall()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))
