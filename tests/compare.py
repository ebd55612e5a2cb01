"""Compare a Spark result with the result of its checking SQL."""

import datetime
import decimal
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def differences(df, con, sql):
    """None if equal, else a short text."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    order = sorted(range(len(names)), key=lambda i: names[i])
    wanted = Counter(tuple((names[i], type(_plain(r[i])).__name__, _plain(r[i])) for i in order) for r in found.fetchall())
    mine = sorted(df.columns)
    got = Counter(tuple((c, type(_plain(r[c])).__name__, _plain(r[c])) for c in mine) for r in df.collect())
    if got == wanted:
        return None
    only_spark, only_sql = got - wanted, wanted - got
    return (
        f"rows {sum(got.values())} / {sum(wanted.values())}; only in Spark {sum(only_spark.values())}, "
        f"e.g. {str(sorted(only_spark, key=str)[:2])[:600]}; only in SQL {str(sorted(only_sql, key=str)[:2])[:600]}"
    )
