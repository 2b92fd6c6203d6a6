"""Composable transaction search and keyset pagination."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centavo.functions.money import minor
from centavo.operators.versions import top_per


def search(
    ledger: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    categories: Sequence[str] | None = None,
    merchants: Sequence[str] | None = None,
    customer_ids: Sequence[int] | None = None,
    direction: str | None = None,
    min_minor: int | None = None,
    mirrors: bool = False,
    transfers: bool = False,
    voided: bool = False,
) -> DataFrame:
    """Transactions by any mix of criteria; mirrors, transfers and voided rows only on request."""
    tests = []
    if start is not None:
        tests.append(F.col("occurred_at") >= F.lit(start))
    if end is not None:
        tests.append(F.col("occurred_at") <= F.lit(end))
    for column, values in (("category", categories), ("merchant_name", merchants), ("customer_id", customer_ids)):
        if values is not None:
            tests.append(F.col(column).isin(*values))
    if direction is not None:
        tests.append(F.col("direction") == direction)
    if min_minor is not None:
        tests.append(minor("amount") >= min_minor)
    if not mirrors:
        tests.append(F.col("is_canonical"))
    if not transfers:
        tests.append(~F.col("is_transfer"))
    if not voided:
        tests.append(~F.col("is_voided"))
    out = ledger
    for test in tests:
        out = out.where(test)
    return out


def page_after(rows: DataFrame, cursor: tuple[dt.date, str, str] | None, n: int) -> DataFrame:
    """The next n rows, newest first, after a (date, record type, id) cursor."""
    day, kind, key = F.col("occurred_at"), F.col("source_record_type"), F.col("source_txn_id")
    if cursor is not None:
        d, k, i = (F.lit(v) for v in cursor)
        rows = rows.where((day < d) | ((day == d) & ((kind > k) | ((kind == k) & (key > i)))))
    return rows.orderBy(day.desc(), kind, key).limit(n)


def pages(rows: DataFrame, cursors: DataFrame, n: int) -> DataFrame:
    """The next page of each tenant: at most n rows, newest first, with `place`, `has_more` and `next_cursor`.

    `cursors`: `org_id, cursor`, one row for each tenant that asks; a null cursor asks for the first page. A cursor is
    `day|record type|id` of the last row seen. Tenants that do not ask get nothing. Each tenant's rows are limited before the shuffle.
    """
    day, kind, key = F.col("occurred_at"), F.col("source_record_type"), F.col("source_txn_id")
    part = F.split("cursor", r"\|", 3)
    asked = cursors.select("org_id", part[0].cast("date").alias("_day"), part[1].alias("_kind"), part[2].alias("_key"))
    after = F.col("_day").isNull() | (day < F.col("_day")) | ((day == F.col("_day")) & ((kind > F.col("_kind")) | ((kind == F.col("_kind")) & (key > F.col("_key")))))
    found = rows.join(asked, "org_id").where(after).drop("_day", "_kind", "_key")
    top = top_per(found, ["org_id"], [day.desc(), kind, key], n + 1)
    cursor = F.concat_ws("|", F.date_format(day, "yyyy-MM-dd"), kind, key)
    ends = top.groupBy("org_id").agg((F.max("rank") > n).alias("has_more"), F.max(F.when(F.col("rank") == n, cursor)).alias("_last"))
    paged = top.where(F.col("rank") <= n).join(ends, "org_id")
    return paged.withColumn("next_cursor", F.when(F.col("has_more"), F.col("_last"))).drop("_last").withColumnRenamed("rank", "place")
