"""Rows of Spark and of DuckDB as comparable multisets."""

from collections import Counter


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(repr(norm(r[c])) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, Counter(tuple(repr(norm(r[i])) for i in at) for r in found.fetchall())
