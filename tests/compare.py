"""Runs a registered query and its SQL on the same parquet files and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def _kind(value):
    return "num" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__


def differences(frame, connection, sql: str) -> str | None:
    """None when names, row count, kinds and values agree."""
    names = sorted(frame.columns)
    spark_rows = [tuple(_plain(r[n]) for n in names) for r in frame.select(*[f"`{n}`" for n in names]).collect()]
    relation = connection.execute(sql)
    described = [c[0] for c in relation.description]
    if sorted(described) != names:
        return f"columns {names} vs {sorted(described)}"
    places = [described.index(n) for n in names]
    duck_rows = [tuple(_plain(r[i]) for i in places) for r in relation.fetchall()]
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows vs {len(duck_rows)}"
    a, b = sorted(spark_rows, key=repr), sorted(duck_rows, key=repr)
    for left, right in zip(a, b):
        if left != right:
            return f"spark {left}\nduckdb {right}"
        for n, x, y in zip(names, left, right):
            if x is not None and type(x) is not type(y) and {type(x), type(y)} != {int, float}:
                return f"{n}: {type(x)} vs {type(y)}"
            if x is not None and type(x) is not type(y):
                return f"{n}: int vs float"
    return None
