"""Row filters shared by every figure."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centavo.functions.periods import Period

# Statement classes and document states.
STATEMENTS = (
    "revenue",
    "cogs",
    "opex",
    "payroll",
    "other_income",
    "other_expense",
    "asset",
    "liability",
    "equity",
)
EXPENSE_STATEMENTS = ("opex", "cogs", "payroll")
OPEN_STATES = ("open", "partial", "overdue")

EARLIEST = dt.date(1900, 1, 1)
LATEST = dt.date(2999, 12, 31)


def analytical(ledger: DataFrame) -> DataFrame:
    """Canonical rows that are neither transfers nor voided: the base of every sum."""
    return ledger.where(F.col("is_canonical") & ~F.col("is_transfer") & ~F.col("is_voided"))


def live(ledger: DataFrame) -> DataFrame:
    """Canonical rows not voided, transfers kept (payroll history, history span)."""
    return ledger.where(F.col("is_canonical") & ~F.col("is_voided"))


#: The month of `occurred_at`, by which a stored ledger is partitioned.
MONTH = "occurred_month"


def occurred(ledger: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Rows that occurred from `start` to `end`. Of a ledger stored by month only those months are read."""
    rows = ledger.where((F.col("occurred_at") >= F.lit(start)) & (F.col("occurred_at") <= F.lit(end)))
    if MONTH in ledger.columns:
        rows = rows.where((F.col(MONTH) >= F.lit(start.replace(day=1))) & (F.col(MONTH) <= F.lit(end)))
    return rows


def in_period(ledger: DataFrame, period: Period, column: str = "occurred_at") -> DataFrame:
    if column == "occurred_at":
        return occurred(ledger, period.start, period.end)
    return ledger.where(period.contains(F.col(column)))


def of_statement(ledger: DataFrame, *statements: str, direction: str | None = None) -> DataFrame:
    unknown = set(statements) - set(STATEMENTS)
    if unknown:
        raise ValueError(f"unknown statement class: {sorted(unknown)}")
    out = ledger.where(F.col("statement").isin(*statements))
    return out if direction is None else out.where(F.col("direction") == direction)


def settled(end: dt.date) -> Column:
    """Cash has moved on or before `end`."""
    return F.col("posted_at").isNotNull() & (F.col("posted_at") <= F.lit(end))


def open_documents(invoices: DataFrame, positive_only: bool = False) -> DataFrame:
    """Invoices still owed; `positive_only` also drops zero balances."""
    out = invoices.where(F.col("status").isin(*OPEN_STATES))
    return out.where(F.col("balance") > 0) if positive_only else out


def live_connections(connections: DataFrame) -> DataFrame:
    return connections.where(F.col("disconnected_at").isNull())


def connections_to_reauthorise(connections: DataFrame) -> DataFrame:
    return live_connections(connections).where(F.col("status") == "reauth_required")


def known_at(versions: DataFrame, as_known_at: Column, keys: list[str]) -> DataFrame:
    """Bitemporal view: the last version of each row ingested by `as_known_at`."""
    from centavo.operators.versions import latest_by

    return latest_by(
        versions.where(F.col("ingested_at") <= as_known_at), keys, [F.col("ingested_at").desc()]
    )
