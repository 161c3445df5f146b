"""Runs a query and its SQL twin and compares columns, types and values."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: [(x is None, str(x)) for x in r])


def compare(spark, connection, plan, sql, sf_dir):
    """None, or what differs."""
    df = plan(spark, sf_dir)
    got = df.collect()
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, found.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    kinds = dict(df.dtypes)
    sql_kinds = {n: str(d[1]) for n, d in zip(names, found.description)}
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, {sorted(names)}: {bad[0][0]} and {bad[0][1]}"
    odd = {n: (kinds[n], k) for n, k in sql_kinds.items() if {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "TINYINT": "tinyint", "SMALLINT": "smallint", "HUGEINT": "?", "DECIMAL": "?"}.get(k.partition("(")[0], kinds[n]) != kinds[n]}
    return f"types {odd}" if odd else None
