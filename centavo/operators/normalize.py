"""Provider documents to canonical transactions, invoices and customers.

Input is a frame of records (`org_id`, `record` VARIANT) of one type. Amounts
are accepted only when the provider sent a JSON number; everything refused is
reported by the matching `*_warnings` function over the same records.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centavo.functions.text import name_key
from centavo.operators.documents import document_status
from centavo.operators.versions import latest_by, lookup

TRANSFORM_VERSION = "1"
UNCATEGORIZED = "uncategorized"
HEADER_CATEGORY = "opex.other"


def text(path: str, record: str = "record") -> Column:
    return F.try_variant_get(record, f"$.{path}", "string")


def date(path: str, record: str = "record") -> Column:
    return F.try_variant_get(record, f"$.{path}", "date")


def _raw(path: str, record: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "variant")


def is_number(path: str, record: str = "record") -> Column:
    kind = F.schema_of_variant(_raw(path, record))
    return F.coalesce(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False))


def amount(path: str, record: str = "record") -> Column:
    """DECIMAL(20,4) in whole cents for a JSON number, else null."""
    value = F.try_variant_get(record, f"$.{path}", "decimal(28,8)")
    cents = F.round(F.round(value, 4), 2).cast("decimal(20,4)")
    return F.when(is_number(path, record), cents)


def _present(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def latest_records(records: DataFrame) -> DataFrame:
    """One version per tenant, type and id: the last updated, then the last fetched, then the later in its page.

    Records without an id cannot be versions of each other: each is keyed by
    its own place in the landing and stays. Records are dealt by key first, so that
    they are sorted once, not in every input task as well.
    """
    place = F.concat_ws("/", "connection_id", "fetched_at", "page_index", "position")
    named = F.coalesce(_present(text("Id")), F.lit(False))
    keyed = records.withColumns(
        {
            "_id": F.when(named, F.concat(F.lit("id:"), text("Id"))).otherwise(F.concat(F.lit("at:"), place)),
            "_updated": F.try_variant_get("record", "$.MetaData.LastUpdatedTime", "timestamp"),
        }
    )
    order = [
        F.col("_updated").desc_nulls_last(),
        F.col("fetched_at").desc(),
        F.col("page_index").desc(),
        F.col("position").desc(),
    ]
    keys = ["org_id", "record_type", "_id"]
    return latest_by(keyed.repartition(*keys), keys, order).drop("_id", "_updated")


def _document_ok() -> Column:
    return F.coalesce(_present(text("Id")) & _present(text("TxnDate")), F.lit(False))


def _lines() -> Column:
    lines = F.try_variant_get("record", "$.Line", "array<variant>")
    return F.coalesce(lines, F.array().cast("array<variant>"))


def _expense_lines(records: DataFrame) -> DataFrame:
    """Header fields with one row per line; documents without lines give one row with a null line."""
    return records.where(_document_ok()).select(
        "org_id",
        amount("TotalAmt").alias("header_amount"),
        text("TotalAmt").alias("header_text"),
        text("Id").alias("doc_id"),
        date("TxnDate").alias("occurred_at"),
        F.coalesce(text("EntityRef.name"), text("VendorRef.name")).alias("party"),
        F.posexplode_outer(_lines()).alias("line_no", "line"),
    )


def normalize_expenses(records: DataFrame, record_type: str, accounts: DataFrame) -> DataFrame:
    """Purchases or bills to outflow rows, one per line, joined with the account mapping."""
    rows = _expense_lines(records)
    header = F.col("line_no").isNull()
    value = F.when(header, F.col("header_amount")).otherwise(amount("Amount", "line"))
    account = text("AccountBasedExpenseLineDetail.AccountRef.value", "line")
    lines = rows.select(
        "org_id",
        F.when(header, F.col("doc_id")).otherwise(F.concat_ws(":", "doc_id", "line_no")).alias("source_txn_id"),
        header.alias("is_header"),
        "occurred_at",
        value.alias("amount"),
        text("Description", "line").alias("description"),
        "party",
        account.alias("source_account_id"),
    ).where(F.col("amount").isNotNull())
    mapping = accounts.select(
        "org_id",
        "source_account_id",
        F.col("statement").alias("account_statement"),
        F.col("name").alias("account_name"),
        F.col("category_key").alias("account_category"),
    )
    joined = lookup(lines, mapping, ["org_id", "source_account_id"], "source_txn_id")
    mapped = F.col("account_statement").isNotNull()
    return joined.select(
        "org_id",
        "source_txn_id",
        F.lit(record_type).alias("source_record_type"),
        F.lit("outflow").alias("direction"),
        "amount",
        "occurred_at",
        (F.col("occurred_at") if record_type == "Purchase" else F.lit(None).cast("date")).alias("posted_at"),
        "description",
        F.coalesce("party", "account_name").alias("merchant_name"),
        "source_account_id",
        F.lit(None).cast("string").alias("source_customer_id"),
        F.col("account_statement").alias("statement"),
        F.when(F.col("is_header"), HEADER_CATEGORY)
        .otherwise(F.coalesce("account_category", F.lit(UNCATEGORIZED)))
        .alias("category_key"),
        F.when(mapped, "source_system").otherwise("default").alias("category_source"),
        F.when(mapped, F.lit("0.9")).otherwise(F.lit("0")).cast("decimal(4,3)").alias("category_confidence"),
        *_flags(),
    )


def _flags() -> list[Column]:
    return [
        F.lit(True).alias("is_canonical"),
        F.lit(False).alias("is_transfer"),
        F.lit(False).alias("is_voided"),
        F.lit(TRANSFORM_VERSION).alias("transform_version"),
    ]


def _inflow(records: DataFrame, record_type: str, statement: str, category: str, settled: bool) -> DataFrame:
    day = date("TxnDate")
    party = text("CustomerRef.name")
    label = {"Payment": ("Payment: ", "Customer payment"), "Invoice": ("Invoice: ", "Invoice")}[record_type]
    return (
        records.where(_document_ok())
        .select(
            "org_id",
            text("Id").alias("source_txn_id"),
            F.lit(record_type).alias("source_record_type"),
            F.lit("inflow").alias("direction"),
            amount("TotalAmt").alias("amount"),
            day.alias("occurred_at"),
            (day if settled else F.lit(None).cast("date")).alias("posted_at"),
            F.coalesce(F.concat(F.lit(label[0]), party), F.lit(label[1])).alias("description"),
            party.alias("merchant_name"),
            F.lit(None).cast("string").alias("source_account_id"),
            text("CustomerRef.value").alias("source_customer_id"),
            F.lit(statement).alias("statement"),
            F.lit(category).alias("category_key"),
            F.lit("source_system").alias("category_source"),
            F.lit("0.95").cast("decimal(4,3)").alias("category_confidence"),
            *_flags(),
        )
        .where(F.col("amount").isNotNull())
    )


def normalize_payments(records: DataFrame) -> DataFrame:
    """Cash received against a receivable: an asset movement, never revenue."""
    return _inflow(records, "Payment", "asset", UNCATEGORIZED, settled=True)


def invoice_revenue(records: DataFrame) -> DataFrame:
    """Accrual revenue, recognised when invoiced; no cash has moved."""
    return _inflow(records, "Invoice", "revenue", "revenue.services", settled=False)


def normalize_invoices(records: DataFrame, as_of: dt.date) -> DataFrame:
    """Invoice documents; an invoice paid in full takes its last update as the paid date."""
    balance = F.when(text("Balance").isNull(), F.lit(0)).otherwise(F.coalesce(amount("Balance"), F.lit(0)))
    rows = (
        records.where(_document_ok())
        .select(
            "org_id",
            text("Id").alias("source_invoice_id"),
            text("DocNumber").alias("number"),
            text("CustomerRef.value").alias("source_customer_id"),
            date("TxnDate").alias("issued_on"),
            date("DueDate").alias("due_date"),
            text("SalesTermRef.value").try_cast("int").alias("terms_days"),
            amount("TotalAmt").alias("total"),
            balance.cast("decimal(20,4)").alias("balance"),
            F.substring(text("MetaData.LastUpdatedTime"), 1, 10).try_cast("date").alias("updated_on"),
        )
        .where(F.col("total").isNotNull())
    )
    paid = F.col("balance") == 0
    return rows.select(
        *[c for c in rows.columns if c != "updated_on"],
        document_status(F.col("total"), F.col("balance"), F.col("due_date"), as_of).alias("status"),
        F.when(paid, F.col("updated_on")).alias("paid_on"),
    )


def normalize_customers(records: DataFrame) -> DataFrame:
    return (
        records.select(
            "org_id",
            text("Id").alias("source_customer_id"),
            F.coalesce(text("DisplayName"), F.lit("Unknown")).alias("name"),
            text("PrimaryEmailAddr.Address").alias("email"),
        )
        .where(F.coalesce(_present(F.col("source_customer_id")), F.lit(False)))
        .withColumn("normalized_name", name_key(F.col("name")))
    )


def _warning(records: DataFrame, kind: str, detail: Column, source_id: Column) -> DataFrame:
    return records.select("org_id", F.lit(kind).alias("kind"), detail.alias("detail"), source_id.alias("source_id"))


def document_warnings(records: DataFrame, record_type: str) -> DataFrame:
    """Documents without id or date, and amounts that are not JSON numbers."""
    missing = _warning(
        records.where(~_document_ok()),
        "missing_field",
        F.lit(f"{record_type} missing Id or TxnDate"),
        F.lit(None).cast("string"),
    )
    if record_type in ("Purchase", "Bill"):
        rows = _expense_lines(records)
        header = F.col("line_no").isNull()
        refused = F.when(header, F.col("header_amount").isNull()).otherwise(amount("Amount", "line").isNull())
        shown = F.when(header, F.col("header_text")).otherwise(text("Amount", "line"))
        bad = rows.where(refused).select("org_id", shown.alias("shown"), "doc_id")
    else:
        bad = records.where(_document_ok() & amount("TotalAmt").isNull()).select(
            "org_id", text("TotalAmt").alias("shown"), text("Id").alias("doc_id")
        )
    detail = F.concat(F.lit("Amount "), F.coalesce("shown", F.lit("missing")))
    return missing.unionByName(_warning(bad, "unparseable_amount", detail, F.col("doc_id")))


def all_transactions(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def resolve_keys(
    transactions: DataFrame, accounts: DataFrame, customers: DataFrame, categories: DataFrame
) -> DataFrame:
    """Source ids and category keys to canonical ids; null when unmatched.

    A tenant's own category wins over the system row of the same key.
    """
    account_ids = accounts.select("org_id", "source_account_id", stable_id("org_id", "source_account_id").alias("ledger_account_id"))
    customer_ids = customers.select("org_id", "source_customer_id", stable_id("org_id", "source_customer_id").alias("customer_id"))
    own = categories.where(F.col("org_id").isNotNull()).select("org_id", F.col("key").alias("category_key"), F.col("category_id").alias("own_id"))
    system = categories.where(F.col("org_id").isNull()).select(F.col("key").alias("category_key"), F.col("category_id").alias("system_id"))
    return (
        transactions.transform(lookup, account_ids, ["org_id", "source_account_id"], "source_txn_id")
        .transform(lookup, customer_ids, ["org_id", "source_customer_id"], "source_txn_id")
        .join(own, ["org_id", "category_key"], "left")
        .join(system, "category_key", "left")
        .withColumn("category_id", F.coalesce("own_id", "system_id"))
        .drop("own_id", "system_id")
    )


def stable_id(*columns: str) -> Column:
    """Identifier derived from the source key, equal on every run; nulls and separators in a value count."""
    named = [F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(columns)]
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)
