"""Compare a query with its SQL, as sets of rows whose values are rounded."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

DATA = Path("/root/testdata")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v if v is None or isinstance(v, int | str) else str(v)


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for f in (DATA / sf).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(df, columns):
    return Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def sql_rows(con, sql, columns):
    c = con.execute(sql)
    names = [d[0] for d in c.description]
    assert sorted(names) == columns
    at = [names.index(n) for n in columns]
    return Counter(repr(tuple(plain(r[i]) for i in at)) for r in c.fetchall())
