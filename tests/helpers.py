"""Comparison of a DataFrame with SQL."""

DATA = "/root/testdata/sf0.001"


def plain(value):
    """Values of either engine in a form that compares."""
    import numpy as np

    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    return value


def agrees(df, con, sql):
    """Same columns and same rows, in any order."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*(f"`{n}`" for n in names)).collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want
