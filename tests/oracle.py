"""Compare registered queries with their SQL on the same parquet files."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime) and value.time() == datetime.time():
        return value.date()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
          "TIMESTAMP": "timestamp_ntz", "VARCHAR[]": "array<string>"}


def differences(df, con, sql: str) -> list[str]:
    """What differs between a Spark result and a DuckDB result; empty when they agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected_types = {n: _TYPES.get(str(d[1]), str(d[1]).lower()) for n, d in zip(names, result.description)}
    expected = _rows(names, result.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = []
    if sorted(names) != sorted(df.columns):
        found.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    types = dict(df.dtypes)
    for n, t in expected_types.items():
        if n in types and types[n] != t:
            found.append(f"type of {n}: {types[n]} != {t}")
    if actual != expected:
        missing, extra = list((expected - actual).items())[:3], list((actual - expected).items())[:3]
        found.append(f"{sum(actual.values())} rows, expected {sum(expected.values())}; "
                     f"missing {missing}; unexpected {extra}")
    if not expected:
        found.append("no rows")
    return found
