"""Rows of a Spark query against those of its SQL, without regard to order."""

import math
from collections import Counter


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in data)


def assert_same(df, cursor):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert not (got[1] - want[1] or want[1] - got[1]), (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
