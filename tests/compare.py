"""Run a registered query on Spark and its SQL on DuckDB, and compare rows and types."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "float": "FLOAT"}


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v) if v is not None and not isinstance(v, (int, bool, str)) else v


def differences(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    made = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} / {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in cur.description}
    ours = dict(df.dtypes)
    odd = {c: (ours[c], kinds[c]) for c in cols if KINDS.get(ours[c], ours[c]) != kinds[c]}
    want = [tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    made.sort(key=key)
    want.sort(key=key)
    if odd:
        return f"types {odd}"
    if len(made) != len(want):
        return f"rows {len(made)} / {len(want)}"
    bad = [(a, b) for a, b in zip(made, want, strict=True) if a != b]
    return f"{len(bad)} of {len(made)} rows differ: {cols} {bad[:2]}" if bad else ""
