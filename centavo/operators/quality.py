"""Counts, coverage, progress, reconciliation and freshness of ingested data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centavo.functions.money import round_half_up
from centavo.operators.predicates import live_connections


def field_coverage(records: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """How many records of a group carry each top-level field, and in percent.

    Counting goes through one aggregation per (group, field); group sizes ride
    along as a field of their own, so no second pass over the records is needed.
    """
    marker = F.lit("")
    fields = F.concat(F.array(marker), F.json_object_keys(F.to_json(record)))
    counts = records.select(*keys, F.explode(fields).alias("field")).groupBy(*keys, "field").agg(F.count("*").alias("n"))
    packed = counts.groupBy(*keys).agg(
        F.max(F.when(F.col("field") == marker, F.col("n"))).alias("records"),
        F.collect_list(F.when(F.col("field") != marker, F.struct("field", "n"))).alias("fields"),
    )
    return packed.select(*keys, "records", F.explode("fields").alias("f")).select(
        *keys,
        "f.field",
        "f.n",
        round_half_up(F.col("f.n").cast("double") / F.col("records") * 100).alias("coverage_pct"),
    )


def canonical_counts(ledger: DataFrame, invoices: DataFrame, customers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows per tenant and table, and accounts waiting for review."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("org_id").agg(F.count("*").alias("n")).select("org_id", F.lit(name).alias("entity"), "n")

    return (
        counted(ledger, "transactions")
        .unionByName(counted(invoices, "invoices"))
        .unionByName(counted(customers, "customers"))
        .unionByName(counted(accounts.where("needs_review"), "accounts_needing_review"))
    )


def sync_progress(checkpoints: DataFrame, pages: DataFrame) -> DataFrame:
    """Per connection and record type: phase, pages and records archived, records seen.

    Archived counts are of unique pages and authoritative; seen may over-count
    after a resume. Pages are summed per key before the join.
    """
    archived = pages.groupBy("connection_id", "record_type").agg(
        F.count("*").alias("pages"), F.sum("record_count").cast("bigint").alias("records_archived")
    )
    zero = F.lit(0).cast("bigint")
    return checkpoints.join(archived, ["connection_id", "record_type"], "left").select(
        "connection_id",
        "record_type",
        "phase",
        F.coalesce("pages", zero).alias("pages"),
        F.coalesce("records_archived", zero).alias("records_archived"),
        "records_seen",
    )


def reconcile(ours: DataFrame, provider: DataFrame, keys: list[str]) -> DataFrame:
    """Our count against the provider's; divergent only when the provider's is known."""
    a = ours.select(*keys, F.col("n").alias("our_count"))
    b = provider.select(*keys, F.col("n").alias("provider_count"))
    counted = F.coalesce("our_count", F.lit(0).cast("bigint"))
    return a.join(b, keys, "full_outer").select(
        *keys,
        counted.alias("our_count"),
        "provider_count",
        (F.col("provider_count").isNotNull() & (F.col("provider_count") != counted)).alias("divergent"),
    )


def data_freshness(connections: DataFrame) -> DataFrame:
    """Last successful sync per tenant and source kind, and whether any connection is not active."""
    return (
        live_connections(connections)
        .groupBy("org_id", "source_kind")
        .agg(
            F.max("last_successful_sync_at").alias("last_sync_at"),
            F.bool_or(F.col("status") != "active").alias("has_degraded_connection"),
        )
    )


def quality_rate(ledger: DataFrame) -> DataFrame:
    """Share of rows and of money without a category, per tenant."""
    from centavo.functions.money import minor, share
    from centavo.operators.predicates import analytical

    missing: Column = F.col("category").isNull() & F.col("statement").isin("opex", "cogs", "payroll")
    spend = F.col("statement").isin("opex", "cogs", "payroll")
    grouped = (
        analytical(ledger)
        .where(spend)
        .groupBy("org_id")
        .agg(
            F.count("*").alias("n"),
            F.count(F.when(missing, 1)).alias("uncategorized_n"),
            F.sum(minor("amount")).alias("total_minor"),
            F.coalesce(F.sum(F.when(missing, minor("amount"))), F.lit(0).cast("bigint")).alias("uncategorized_minor"),
        )
    )
    return grouped.withColumns(
        {
            "uncategorized_share": share(F.col("uncategorized_n"), F.col("n")),
            "uncategorized_amount_share": share(F.col("uncategorized_minor"), F.col("total_minor")),
        }
    )


def unreconciled(decisions: DataFrame) -> DataFrame:
    """Rows per tenant and source that have no counterpart in another source, and their share.

    `decisions`: what `cross_source_duplicates` decided. A row is reconciled when it mirrors another or is mirrored.
    """
    from centavo.functions.money import round_half_up

    mirrored = decisions.where("mirrors_row_id IS NOT NULL").select(F.col("mirrors_row_id").alias("row_id"), F.lit(True).alias("_met")).distinct()
    rows = decisions.join(mirrored, "row_id", "left")
    alone = F.col("mirrors_row_id").isNull() & F.col("_met").isNull()
    counted = rows.groupBy("org_id", "source").agg(F.count("*").alias("n"), F.count_if(alone).alias("unreconciled_n"))
    return counted.withColumn("unreconciled_share", round_half_up(F.col("unreconciled_n").cast("double") / F.col("n").cast("double"), 4))
