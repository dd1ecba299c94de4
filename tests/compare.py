"""Run registered queries and their SQL on the same tables and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(_plain(r[i])) for i in order) for r in rows)


def compare(name, spark, con, sf_dir, query, sql):
    """(ok, message) for one query."""
    start = time.time()
    df = query(spark, sf_dir)
    mine = df.collect()
    seconds = time.time() - start
    if sql is None:
        return True, f"{name}: {len(mine)} rows, no SQL, {seconds:.1f}s"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} against {sorted(columns)}"
    a, b = normalized(df.columns, mine), normalized(columns, theirs)
    if a == b:
        return True, f"{name}: {len(a)} rows, {seconds:.1f}s"
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return False, f"{name}: {len(a)} against {len(b)} rows\n   columns {sorted(columns)}\n   spark  {only_a}\n   duckdb {only_b}"[:3000]
