"""Runs a query and its SQL over one folder of tables and compares them as bags of rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.7g}"
    return float(x) if type(x).__name__ == "Decimal" else x


def differences(spark, query, text: str, sf_dir: str) -> list:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(text)
    names = [c[0] for c in got.description]
    want = sorted([tuple(plain(v) for _, v in sorted(zip(names, r))) for r in got.fetchall()], key=repr)
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    have = sorted([tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()], key=repr)
    norm = lambda rows: [tuple(str(v) if not isinstance(v, (int, str, type(None))) else v for v in r) for r in rows]
    a, b = norm(have), norm(want)
    return [] if a == b else [len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]]
