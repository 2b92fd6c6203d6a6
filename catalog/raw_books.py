"""Provider pages derived from the order-management tables, for replay and checks.

Every record comes from a row of the given tables; the irregular cases a real
provider sends (quoted amounts, missing ids, lines without account, pages
fetched twice, later versions of a record) are set by key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centavo.sources.books import Books
from centavo.sources.landing import PAGE_SIZE

TENANTS = 25
FIRST_FETCH = "2001-07-20 00:00:00"
SECOND_FETCH = "2001-07-30 00:00:00"
# Pages of edited invoices are numbered from here on.
EDITED_PAGES = 1_000_000

# Chart-of-accounts names, types and subtypes given to parts by key.
ACCOUNT_NAMES = (
    "Payroll Clearing",
    "Salaries",
    "Office Rent",
    "Software Subscriptions",
    "Marketing",
    "Travel and Meals",
    "Legal Fees",
    "Health Insurance",
    "Internet",
    "Office Supplies",
    "Subcontractors",
    "Interest Paid",
    "Income Tax",
    "Cloud Hosting",
    "Materials",
    "Bank Charges",
    "Retainer Income",
)
ACCOUNT_TYPES = (
    "Income",
    "Other Income",
    "Cost of Goods Sold",
    "Bank",
    "Credit Card",
    "Equity",
    "Long Term Liability",
    "Accounts Payable",
    "Fixed Asset",
    "Accounts Receivable",
    "Expense",
    "Other Expense",
    "Memo",
)
ACCOUNT_SUBTYPES = (
    "PayrollTaxExpense",
    "PayrollWageExpenses",
    "SuppliesMaterialsCogs",
    "CostOfServiceCos",
)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


@dataclass(frozen=True)
class Records:
    """Records that are not written out yet: their rows, dealt by page, and how a row becomes JSON text."""

    rows: DataFrame
    text: Callable[[Column], Column]


def account_records(b: Books) -> Records:
    return _keyed(b.table("part"), "Account", "p_partkey", ["p_partkey"], _account_json)


def _account_json(row: Column) -> Column:
    key = row["p_partkey"]
    subtype = F.when(key % 7 == 0, _pick(ACCOUNT_SUBTYPES, (key / 7).cast("bigint") % len(ACCOUNT_SUBTYPES)))
    record = F.struct(
        F.when(key % 211 != 3, key.cast("string")).alias("Id"),
        F.when(key % 53 != 5, _pick(ACCOUNT_NAMES, key % len(ACCOUNT_NAMES))).alias("Name"),
        F.when(key % 101 != 7, _pick(ACCOUNT_TYPES, key % len(ACCOUNT_TYPES))).alias("AccountType"),
        subtype.alias("AccountSubType"),
        F.struct(F.lit("2001-07-01T00:00:00Z").alias("LastUpdatedTime")).alias("MetaData"),
    )
    return F.to_json(record)


def customer_records(b: Books) -> Records:
    return _keyed(b.table("customer"), "Customer", "c_custkey", ["c_custkey", "c_name"], _customer_json)


def _customer_json(row: Column) -> Column:
    key = row["c_custkey"]
    email = F.concat(F.lit("billing"), key.cast("string"), F.lit("@example.com"))
    record = F.struct(
        F.when(key % 307 != 4, key.cast("string")).alias("Id"),
        F.when(key % 41 != 6, row["c_name"]).alias("DisplayName"),
        F.when(key % 4 != 0, F.struct(email.alias("Address"))).alias("PrimaryEmailAddr"),
    )
    return F.to_json(record)


ORDER_FIELDS = ["key", "cust", "state", "total", "day", "version"]


def _order_fields(b: Books) -> DataFrame:
    return b.table("orders").select(
        F.col("o_orderkey").alias("key"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").cast("date").alias("day"),
    )


def _customer_ref(row: Column) -> Column:
    name = F.format_string("Customer#%09d", row["cust"])
    return F.struct(row["cust"].cast("string").alias("value"), F.when(row["cust"] % 6 != 0, name).alias("name"))


def _invoice_json(row: Column) -> Column:
    """An invoice as first fetched (`version` 0: nothing paid yet, or half paid) or as edited later (1: paid in full)."""
    key, total, day, edited = row["key"], row["total"], row["day"], row["version"] == 1
    half = F.round(total.cast("decimal(20,6)") * F.lit("0.5").cast("decimal(2,1)"), 2).cast("double")
    balance = F.when(edited, F.lit(0.0)).when(row["state"] == "P", half).otherwise(total)
    updated = F.concat(F.when(edited, F.date_add(day, 40)).otherwise(day).cast("string"), F.lit("T08:00:00Z"))
    terms = F.when(row["cust"] % 3 == 0, 15).otherwise(30)

    def shape(total: Column) -> Column:
        return F.to_json(
            F.struct(
                F.when(key % 503 != 9, key.cast("string")).alias("Id"),
                F.concat(F.lit("INV-"), key.cast("string")).alias("DocNumber"),
                F.when(key % 401 != 11, day.cast("string")).alias("TxnDate"),
                F.when(key % 97 != 0, F.date_add(day, terms)).cast("string").alias("DueDate"),
                _customer_ref(row).alias("CustomerRef"),
                total.alias("TotalAmt"),
                balance.alias("Balance"),
                F.struct(terms.cast("string").alias("value")).alias("SalesTermRef"),
                F.struct(updated.alias("LastUpdatedTime")).alias("MetaData"),
            )
        )

    return F.when(key % 199 == 13, shape(total.cast("string"))).otherwise(shape(total))


def _invoices(orders: DataFrame) -> Records:
    return _keyed(orders, "Invoice", "key", ORDER_FIELDS, _invoice_json, "cust")


def invoice_records(b: Books) -> Records:
    """First versions: nothing paid yet, or half paid."""
    return _invoices(_order_fields(b).withColumn("version", F.lit(0)))


def invoice_edits(b: Books) -> Records:
    """Later versions of finished orders: paid in full."""
    return _invoices(_order_fields(b).where(F.col("state") == "F").withColumn("version", F.lit(1)))


def invoice_versions(b: Books) -> Records:
    """Both of them from one pass over the orders."""
    versions = F.when(F.col("state") == "F", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return _invoices(_order_fields(b).withColumn("version", F.explode(versions)))


def payment_records(b: Books) -> Records:
    return _keyed(_order_fields(b).where(F.col("state") == "F"), "Payment", "key", ["key", "cust", "total", "day"], _payment_json, "cust")


def _payment_json(row: Column) -> Column:
    key = row["key"]
    return F.to_json(
        F.struct(
            F.when(key % 601 != 15, key.cast("string")).alias("Id"),
            F.date_add(row["day"], 40).cast("string").alias("TxnDate"),
            _customer_ref(row).alias("CustomerRef"),
            F.when(key % 701 != 17, row["total"]).alias("TotalAmt"),
        )
    )


def expense_records(b: Books, record_type: str) -> Records:
    """One document per order and line state, its lines in line order.

    Lines are unique per order and line number before they are collected, so a
    document holds as many lines as the order has line numbers.
    """
    state, party = ("F", "EntityRef") if record_type == "Purchase" else ("O", "VendorRef")
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    tenant = key % TENANTS
    account = (
        F.when(part % 37 == 0, None)
        .when(part % 41 == 0, F.lit("999999999"))
        .otherwise((part - part % TENANTS + tenant).cast("string"))
    )
    line = F.struct(
        F.col("l_linenumber").alias("n"),
        F.col("l_extendedprice").alias("Amount"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"))).alias(
            "Description"
        ),
        F.when(account.isNotNull(), F.struct(F.struct(account.alias("value")).alias("AccountRef"))).alias(
            "AccountBasedExpenseLineDetail"
        ),
    )
    docs = (
        b.line_items.where(F.col("l_linestatus") == state)
        .groupBy(key.alias("key"))
        .agg(
            F.min(F.col("l_shipdate").cast("date")).cast("string").alias("day"),
            F.min("l_suppkey").alias("party"),
            F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).cast("double").alias("total"),
            F.array_sort(F.collect_list(line)).alias("lines"),
        )
    )

    def text(row: Column) -> Column:
        key = row["key"]
        record = F.struct(
            F.when(key % 503 != 9, key.cast("string")).alias("Id"),
            row["day"].alias("TxnDate"),
            row["total"].alias("TotalAmt"),
            F.when(key % 4 != 0, F.struct(F.format_string("Supplier#%09d", row["party"]).alias("name"))).alias(party),
            F.when(key % 29 != 0, F.transform(row["lines"], lambda e: e.dropFields("n"))).alias("Line"),
        )
        return F.to_json(record)

    return _keyed(docs, record_type, "key", ["key", "day", "party", "total", "lines"], text)


def _keyed(
    df: DataFrame, record_type: str, key: str, fields: list[str], text: Callable[[Column], Column], tenant: str | None = None
) -> Records:
    """Rows are dealt by page as they are; their text, many times as long, is made a page at a time."""
    version = F.col("version") if "version" in df.columns else F.lit(0)
    rows = df.select(
        (F.col(tenant or key) % TENANTS).cast("int").alias("org_id"),
        F.lit(record_type).alias("record_type"),
        (F.col(key) / PAGE_SIZE).cast("bigint").cast("int").alias("page"),
        version.alias("version"),
        F.struct(F.col(key).alias("_key"), *fields).alias("row"),
    )
    return Records(rows.repartition("org_id", "page", "version"), text)


def _bodies(records: Records) -> DataFrame:
    """The records of each page as text, by key range: at most one page of keys in each."""
    grouped = records.rows.groupBy("org_id", "record_type", "page", "version").agg(
        F.collect_list("row").alias("rows"), F.count("*").alias("n")
    )
    written = F.transform("rows", lambda e: F.struct(e["_key"].alias("key"), records.text(e).alias("record")))
    return grouped.withColumn("body", F.array_join(F.transform(F.array_sort(written), lambda e: e["record"]), ","))


def _fetched(bodies: DataFrame, page_index: Column, fetched_at: Column) -> DataFrame:
    return bodies.select(
        "org_id",
        F.concat(F.lit("conn-"), F.col("org_id").cast("string")).alias("connection_id"),
        "record_type",
        page_index.alias("page_index"),
        fetched_at.cast("timestamp").alias("fetched_at"),
        F.concat(
            F.lit('{"QueryResponse":{"'),
            F.col("record_type"),
            F.lit('":['),
            F.col("body"),
            F.lit('],"startPosition":1,"maxResults":'),
            F.col("n").cast("string"),
            F.lit('},"time":"'),
            fetched_at,
            F.lit('"}'),
        ).alias("payload"),
    )


def to_pages(records: Records, fetched_at: str, first_page: int = 0) -> DataFrame:
    """Group records into pages by key range: at most one page of keys in each."""
    return _fetched(_bodies(records), F.col("page") + first_page, F.lit(fetched_at))


def refetched(pages: DataFrame, fetched_at: str) -> DataFrame:
    """Every third page as a retry sees it: same records, another envelope time."""
    return pages.where(F.col("page_index") % 3 == 0).select(
        "org_id",
        "connection_id",
        "record_type",
        "page_index",
        F.lit(fetched_at).cast("timestamp").alias("fetched_at"),
        F.regexp_replace("payload", '"time":"[^"]*"', f'"time":"{fetched_at}"').alias("payload"),
    )


SOURCES = {
    "Account": account_records,
    "Customer": customer_records,
    "Invoice": invoice_versions,
    "Payment": payment_records,
    "Purchase": lambda b: expense_records(b, "Purchase"),
    "Bill": lambda b: expense_records(b, "Bill"),
}


def pages(b: Books, record_type: str) -> DataFrame:
    """All fetched pages of one type, retries and later versions included, as they were landed."""
    return b.landed(f"pages-{record_type}", lambda: _pages(b, record_type))


def _pages(b: Books, record_type: str) -> DataFrame:
    """Each page is put together once; a first one fetched again (see `refetched`) gets a row per fetch."""
    first, second = F.lit(FIRST_FETCH), F.lit(SECOND_FETCH)
    edited = F.col("version") == 1
    fetches = F.when(edited, F.array(second)).when(F.col("page") % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    made = _bodies(SOURCES[record_type](b)).withColumn("fetched", F.explode(fetches))
    return _fetched(made, F.col("page") + F.when(edited, EDITED_PAGES).otherwise(0), F.col("fetched"))
