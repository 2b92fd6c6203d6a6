"""Breakdowns of a figure by label, and the rows behind a figure."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centavo.functions.money import minor, share
from centavo.functions.periods import Period
from centavo.operators.predicates import EARLIEST, EXPENSE_STATEMENTS, LATEST, analytical, in_period, occurred
from centavo.operators.versions import top_per

AGING_BUCKETS = ("Current", "1-30 days", "31-60 days", "61-90 days", "90+ days")


def with_share(rows: DataFrame, value: str = "total_minor", count: str = "n") -> DataFrame:
    """Add each row's share of its tenant's total and the tenant's row count.

    Tenant totals come from a second aggregation joined back, not from a window
    over the tenant: a tenant may hold a third of all labels. Both branches read
    the same aggregate, whose exchange Spark reuses.
    """
    totals = rows.groupBy("org_id").agg(
        F.sum(value).alias("org_total_minor"), F.sum(count).alias("org_source_count")
    )
    return (
        rows.join(totals, "org_id")
        .withColumn("share", share(F.col(value), F.col("org_total_minor")))
        .drop("org_total_minor")
    )


def expense_rows(ledger: DataFrame) -> DataFrame:
    return analytical(ledger).where(F.col("statement").isin(*EXPENSE_STATEMENTS))


def category_label() -> Column:
    return F.coalesce(F.col("category"), F.lit("Uncategorized"))


def expenses_by_category(ledger: DataFrame, period: Period) -> DataFrame:
    totals = (
        in_period(expense_rows(ledger), period)
        .groupBy("org_id", category_label().alias("label"))
        .agg(F.sum(minor("amount")).alias("total_minor"), F.count("*").alias("n"))
    )
    return with_share(totals)


def customer_totals(ledger: DataFrame, customers: DataFrame, period: Period) -> DataFrame:
    """Revenue per customer name; sums per customer id come first, then the name is looked up."""
    by_id = (
        in_period(analytical(ledger).where(F.col("statement") == "revenue"), period)
        .groupBy("org_id", "customer_id")
        .agg(F.sum(minor("amount")).alias("total_minor"), F.count("*").alias("n"))
    )
    named = by_id.join(customers.select("org_id", "customer_id", "name"), ["org_id", "customer_id"], "left")
    return named.groupBy("org_id", F.coalesce("name", F.lit("Unattributed")).alias("label")).agg(
        F.sum("total_minor").alias("total_minor"), F.sum("n").alias("n")
    )


def revenue_by_customer(ledger: DataFrame, customers: DataFrame, period: Period) -> DataFrame:
    return with_share(customer_totals(ledger, customers, period))


def top_labels(rows: DataFrame, n: int, value: str = "total_minor") -> DataFrame:
    """The n largest labels of each tenant, ties broken by label."""
    return top_per(rows, ["org_id"], [F.col(value).desc(), F.col("label")], n)


def concentration(ledger: DataFrame, customers: DataFrame, period: Period, warn_above: float = 0.3) -> DataFrame:
    """The largest customer's share of revenue per tenant."""
    by_customer = customer_totals(ledger, customers, period)
    best = F.min(F.struct((-F.col("total_minor")).alias("neg"), F.col("label").alias("label")))
    top = by_customer.groupBy("org_id").agg(best.alias("best"), F.sum("total_minor").alias("org_total"))
    ratio = share(-F.col("best.neg"), F.col("org_total"))
    return top.select(
        "org_id",
        F.col("best.label").alias("customer"),
        (-F.col("best.neg")).alias("total_minor"),
        ratio.alias("share"),
        (ratio > warn_above).alias("concentrated"),
    )


def aging_bucket(due_date: Column, as_of: dt.date) -> Column:
    """Age class of a receivable; a missing due date counts as the oldest."""
    day = F.lit(as_of)
    out = F.when(due_date >= day, AGING_BUCKETS[0])
    for limit, label in zip((30, 60, 90), AGING_BUCKETS[1:4], strict=True):
        out = out.when(due_date >= F.date_sub(day, limit), label)
    return out.otherwise(AGING_BUCKETS[4])


def receivables_aging(invoices: DataFrame, as_of: dt.date) -> DataFrame:
    from centavo.operators.predicates import open_documents

    return (
        open_documents(invoices)
        .groupBy("org_id", aging_bucket(F.col("due_date"), as_of).alias("bucket"))
        .agg(F.sum(minor("balance")).alias("balance_minor"), F.count("*").alias("n"))
        .withColumn(
            "bucket_order", F.array_position(F.array(*[F.lit(b) for b in AGING_BUCKETS]), F.col("bucket")).cast("int")
        )
    )


def expense_change(ledger: DataFrame, current: Period, prior: Period) -> DataFrame:
    """What moved between two periods: per category both sums, the change and its share.

    Shares are of the total absolute movement. One scan serves both periods.
    """
    day = F.col("occurred_at")
    amount = minor("amount")
    zero = F.lit(0).cast("bigint")
    rows = occurred(expense_rows(ledger), min(current.start, prior.start), max(current.end, prior.end))
    rows = rows.where(current.contains(day) | prior.contains(day))
    sums = rows.groupBy("org_id", category_label().alias("label")).agg(
        F.coalesce(F.sum(F.when(current.contains(day), amount)), zero).alias("current_minor"),
        F.coalesce(F.sum(F.when(prior.contains(day), amount)), zero).alias("prior_minor"),
    )
    moves = sums.withColumn("delta_minor", F.col("current_minor") - F.col("prior_minor")).withColumn(
        "movement", F.abs("delta_minor")
    )
    totals = moves.groupBy("org_id").agg(F.sum("movement").alias("org_movement"))
    return moves.join(totals, "org_id").select(
        "org_id",
        "label",
        "current_minor",
        "prior_minor",
        "delta_minor",
        share(F.col("movement"), F.col("org_movement")).alias("share_of_change"),
    )


def top_drivers(changes: DataFrame, n: int = 6) -> DataFrame:
    return top_per(changes, ["org_id"], [F.abs("delta_minor").desc(), F.col("label")], n)


def drill_down(
    ledger: DataFrame,
    start: dt.date = EARLIEST,
    end: dt.date = LATEST,
    statement: str | None = None,
    n: int = 100,
) -> DataFrame:
    """The n largest rows behind a figure, per tenant, ties broken by source key."""
    rows = occurred(analytical(ledger), start, end)
    if statement is not None:
        rows = rows.where(F.col("statement") == statement)
    slim = rows.select(
        "org_id",
        F.col("occurred_at").alias("date"),
        "merchant_name",
        minor("amount").alias("amount_minor"),
        "direction",
        category_label().alias("category"),
        "source_record_type",
        "source_txn_id",
    )
    order = [F.col("amount_minor").desc(), F.col("source_record_type"), F.col("source_txn_id")]
    return top_per(slim, ["org_id"], order, n)
