"""Compare a query's rows with the rows its SQL gives on the same tables."""

from __future__ import annotations

import datetime as dt
import math
import os
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(path: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}"
    if isinstance(value, Decimal):
        return f"decimal {value}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _norm(v)) for k, v in value.items()))
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    got_columns = sorted(df.columns)
    got = _sorted(tuple(_norm(v) for v in r) for r in df.select(got_columns).collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_columns = sorted(names)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    index = [names.index(c) for c in want_columns]
    want = _sorted(tuple(_norm(r[i]) for i in index) for r in cursor.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}\n spark {got[:2]}\n sql   {want[:2]}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            bad = [c for c, x, y in zip(got_columns, a, b, strict=True) if x != y]
            return f"differs in {bad}\n spark {a}\n sql   {b}"
    if not got:
        return "no rows on either side"
    return None


def session(cores: str = "8", partitions: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_TEST_MEMORY", "6g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
