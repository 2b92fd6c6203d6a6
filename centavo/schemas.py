"""Schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(20, 4)
CONFIDENCE = T.DecimalType(4, 3)


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


LEDGER = _table(
    ("org_id", T.IntegerType()),
    ("source", T.StringType()),
    ("source_txn_id", T.StringType()),
    ("source_record_type", T.StringType()),
    ("direction", T.StringType()),
    ("amount", MONEY),
    ("occurred_at", T.DateType()),
    ("posted_at", T.DateType()),
    ("merchant_name", T.StringType()),
    ("category", T.StringType()),
    ("statement", T.StringType()),
    ("customer_id", T.LongType()),
    ("is_canonical", T.BooleanType()),
    ("is_transfer", T.BooleanType()),
    ("is_voided", T.BooleanType()),
)

INVOICES = _table(
    ("org_id", T.IntegerType()),
    ("invoice_id", T.LongType()),
    ("customer_id", T.LongType()),
    ("issued_on", T.DateType()),
    ("due_date", T.DateType()),
    ("total", MONEY),
    ("paid_on", T.DateType()),
    ("balance", MONEY),
    ("status", T.StringType()),
)

CUSTOMERS = _table(("org_id", T.IntegerType()), ("customer_id", T.LongType()), ("name", T.StringType()))

METRICS = _table(
    ("org_id", T.IntegerType()),
    ("metric_key", T.StringType()),
    ("period_start", T.DateType()),
    ("period_end", T.DateType()),
    ("grain", T.StringType()),
    ("unit", T.StringType()),
    ("value_minor", T.LongType()),
    ("value", T.DoubleType()),
    ("confidence", T.StringType()),
    ("reason", T.StringType()),
    ("source_count", T.LongType()),
    ("drill_statement", T.StringType()),
    ("engine_version", T.StringType()),
)

FORECAST_POINTS = _table(
    ("org_id", T.IntegerType()),
    ("date", T.DateType()),
    ("p10", T.LongType()),
    ("p50", T.LongType()),
    ("p90", T.LongType()),
    ("committed", T.LongType()),
    ("receivables", T.LongType()),
    ("variable", T.LongType()),
)
