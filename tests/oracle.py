"""Compare a query with its SQL over the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, _plain(x)) for k, x in v.asDict().items())
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if v is None or v is pd.NaT:
        return None
    return v if isinstance(v, (int, str, bytes, bool, tuple)) else _plain(float(v)) if hasattr(v, "__float__") else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in found), key=repr)


def compare(df, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    have = rows(df.columns, df.collect())
    assert len(have) == len(want), (len(have), len(want))
    for a, b in zip(have, want):
        assert a == b
    return len(have)
