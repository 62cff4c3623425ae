"""A query's rows beside those of its SQL, the way the driver compares them: columns by name, rows in any order."""

import math
from pathlib import Path

import duckdb


def connect(data: str):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(data).iterdir():
        if p.suffix == ".parquet":
            c.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, int):
        return v
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def compare(spark, c, query, sql, data):
    """None if the two agree, else what differs."""
    df = query(spark, data)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return f"{len(mine)} and {len(theirs)} rows; only here {list(a)[:2]}; only in SQL {list(b)[:2]}"
    return None
