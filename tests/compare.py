"""Comparing a Spark result with DuckDB's, by value and without order."""

import datetime
import math


def canon(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(canon, x)) + "]"
    if isinstance(x, datetime.datetime):
        return str(x.replace(tzinfo=None))
    return str(x)


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted(tuple(canon(v) for v in r) for r in df.select([f"`{c}`" for c in cols]).collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(canon(r[i]) for i in at) for r in result.fetchall())
    assert got == want
