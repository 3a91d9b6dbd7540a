"""Compares a Spark result with that of a second engine, as multisets of rows."""

import datetime
import decimal
import math


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        if isinstance(x, float) and math.isnan(x):
            return None
        y = float(x)
        return 0.0 if y == 0 else y
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((v is None, str(type(v)), repr(v)) for v in r))


def same(a, b, tolerance=2e-6):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=tolerance)
    return a == b


def difference(df, con, sql):
    """None, or what differs first."""
    cols, got = rows(df.columns, df.collect())
    found = con.execute(sql)
    want_cols, want = rows([c[0] for c in found.description], found.fetchall())
    if cols != want_cols:
        return f"columns {cols}, expected {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; first {got[:1]} {want[:1]}"
    if got == want:
        return None
    near = next(((g, w) for g, w in zip(got, want) if not all(map(same, g, w))), None)
    exact = sum(g != w for g, w in zip(got, want))
    return f"{exact} rows differ; first {near}" if near else f"{exact} rows differ in rounding only"
