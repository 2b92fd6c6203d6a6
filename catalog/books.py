"""Merges, tenancy, search, sync bookkeeping, snapshots, import, retention, export."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog import raw_books
from catalog.ingest import unique
from catalog.metrics import METRIC_SQL, PNL, TTM, metric_select
from catalog.registry import query
from centavo.functions.money import minor
from centavo.operators import metrics, predicates, quality, search, tenancy, versions
from centavo.session import fresh_path, written
from centavo.sources import files, landing, snapshots
from centavo.sources.books import AS_OF
from centavo.sources.ledger import KEYS, LedgerTable

# --- merges -----------------------------------------------------------------


def part_accounts(b):
    statement = F.when(F.col("p_type") == "SMALL", "payroll").otherwise("opex")
    return b.table("part").select(
        (F.col("p_partkey") % 25).cast("int").alias("org_id"),
        F.col("p_partkey").cast("string").alias("source_account_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("account_type"),
        statement.alias("statement"),
        F.lit("0.60").cast("decimal(4,3)").alias("mapping_confidence"),
        (F.col("p_size") > 40).alias("needs_review"),
    )


@query(
    "upsert_ledger_accounts",
    "S-6",
    sql="""SELECT CAST(p_partkey % 25 AS INT) AS org_id, CAST(p_partkey AS VARCHAR) AS source_account_id,
CASE WHEN p_retailprice > 1000 THEN p_brand || ' ' || p_name ELSE p_name END AS name, p_type AS account_type,
CASE WHEN p_retailprice > 1000 THEN 'cogs' WHEN p_type = 'SMALL' THEN 'payroll' ELSE 'opex' END AS statement,
CAST(CASE WHEN p_retailprice > 1000 THEN 920 ELSE 600 END AS INT) AS confidence_milli, CASE WHEN p_retailprice > 1000 THEN FALSE ELSE p_size > 40 END AS needs_review FROM part
UNION ALL SELECT CAST(s_suppkey % 25 AS INT), 'S' || s_suppkey, s_name, 'Accounts Payable', 'cogs', 920, FALSE FROM supplier""",
    views=False,
)
def upsert_ledger_accounts(b):
    conf = F.lit("0.92").cast("decimal(4,3)")
    changed = b.table("part").where(F.col("p_retailprice") > 1000).select(
        (F.col("p_partkey") % 25).cast("int").alias("org_id"),
        F.col("p_partkey").cast("string").alias("source_account_id"),
        F.concat_ws(" ", "p_brand", "p_name").alias("name"),
        F.lit("Cost of Goods Sold").alias("account_type"),
        F.lit("cogs").alias("statement"),
        conf.alias("mapping_confidence"),
        F.lit(False).alias("needs_review"),
        F.lit(2).alias("version"),
    )
    added = b.table("supplier").select(
        (F.col("s_suppkey") % 25).cast("int").alias("org_id"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("source_account_id"),
        F.col("s_name").alias("name"),
        F.lit("Accounts Payable").alias("account_type"),
        F.lit("cogs").alias("statement"),
        conf.alias("mapping_confidence"),
        F.lit(False).alias("needs_review"),
        F.lit(2).alias("version"),
    )
    stale = changed.withColumn("name", F.lit("superseded")).withColumn("version", F.lit(1))
    merged = versions.merge_update(
        part_accounts(b),
        changed.unionByName(added).unionByName(stale),
        ["org_id", "source_account_id"],
        ["name", "statement", "mapping_confidence", "needs_review"],
        [F.col("version").desc()],
    )
    return merged.withColumn("confidence_milli", (F.col("mapping_confidence") * 1000).cast("int")).drop(
        "mapping_confidence"
    )


@query(
    "upsert_customers",
    "S-7",
    sql="""SELECT CAST(c_nationkey AS INT) AS org_id, CAST(c_custkey AS VARCHAR) AS source_customer_id, CASE WHEN c_acctbal < 0 THEN c_name || ' Ltd' ELSE c_name END AS name, c_mktsegment AS email FROM customer
UNION ALL SELECT CAST(s_nationkey AS INT), 'S' || s_suppkey, s_name, 'new' FROM supplier""",
    views=False,
)
def upsert_customers(b):
    existing = b.table("customer").select(
        F.col("c_nationkey").cast("int").alias("org_id"),
        F.col("c_custkey").cast("string").alias("source_customer_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("email"),
    )
    renamed = b.table("customer").where(F.col("c_acctbal") < 0).select(
        F.col("c_nationkey").cast("int").alias("org_id"),
        F.col("c_custkey").cast("string").alias("source_customer_id"),
        F.concat("c_name", F.lit(" Ltd")).alias("name"),
        F.lit("changed").alias("email"),
    )
    added = b.table("supplier").select(
        F.col("s_nationkey").cast("int").alias("org_id"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("source_customer_id"),
        F.col("s_name").alias("name"),
        F.lit("new").alias("email"),
    )
    return versions.merge_update(
        existing, renamed.unionByName(added), ["org_id", "source_customer_id"], ["name"], [F.col("name")]
    )


@query(
    "insert_transactions_if_absent",
    "S-8",
    "J-8",
    sql=""", old AS (SELECT org_id, source_record_type, source_txn_id FROM ledger_c WHERE occurred_at < DATE '2001-07-01' AND NOT is_voided), new AS (SELECT * FROM ledger_c WHERE occurred_at >= DATE '2001-06-01')
SELECT org_id, 'accounting' AS source, source_record_type, source_txn_id, occurred_at, CAST(amount * 100 AS BIGINT) AS amount_minor, is_voided FROM new
ANTI JOIN old USING (org_id, source_record_type, source_txn_id)""",
)
def insert_transactions_if_absent(b):
    """A second batch that overlaps the first by a month, run twice as after a crash: what it added to the stored ledger."""
    table = LedgerTable(b.spark, fresh_path(b.spark, "merged"), b.ledger_table.schema, b.ledger_table.buckets)
    table.merge(b.ledger_table.read(end=dt.date(2001, 6, 30)), 0)
    for _ in range(2):
        table.merge(b.ledger_table.read(start=dt.date(2001, 6, 1)), 1)
    added = table.read(start=dt.date(2001, 6, 1)).where("batch_id = 1")
    return added.select(*KEYS, "occurred_at", minor("amount").alias("amount_minor"), "is_voided")


@query(
    "stored_ledger",
    "S-8",
    "P-1",
    "J-7",
    sql="""SELECT org_id, CAST(date_trunc('month', occurred_at) AS DATE) AS occurred_month, source_record_type, COUNT(*) AS n, CAST(SUM(amount * 100) AS BIGINT) AS amount_minor,
COUNT(CASE WHEN is_canonical AND NOT is_transfer AND NOT is_voided THEN 1 END) AS analytical_n FROM ledger_c GROUP BY 1, 2, 3""",
)
def stored_ledger(b):
    """The canonical ledger as it is stored: written once, read by month."""
    used = F.col("is_canonical") & ~F.col("is_transfer") & ~F.col("is_voided")
    return b.ledger_table.read().groupBy("org_id", "occurred_month", "source_record_type").agg(
        F.count("*").alias("n"), F.sum(minor("amount")).alias("amount_minor"), F.count_if(used).alias("analytical_n")
    )


@query(
    "upsert_invoices",
    "S-9",
    sql="""SELECT org_id, invoice_id, CASE WHEN issued_on < DATE '2001-07-01' THEN total_minor ELSE total_minor + 100 END AS total_minor,
CASE WHEN issued_on < DATE '2001-01-01' THEN total_minor ELSE balance_minor END AS balance_minor,
CASE WHEN issued_on < DATE '2001-01-01' THEN 'open' ELSE status END AS status, CASE WHEN issued_on >= DATE '2001-01-01' THEN paid_on END AS paid_on FROM docs""",
)
def upsert_invoices(b):
    rows = b.invoices.select(
        "org_id",
        "invoice_id",
        "issued_on",
        minor("total").alias("total_minor"),
        minor("balance").alias("balance_minor"),
        "status",
        "paid_on",
    )
    existing = (
        rows.where(F.col("issued_on") < F.lit(dt.date(2001, 7, 1)))
        .withColumns(
            {"balance_minor": F.col("total_minor"), "status": F.lit("open"), "paid_on": F.lit(None).cast("date")}
        )
        .drop("issued_on")
    )
    incoming = (
        rows.where(F.col("issued_on") >= F.lit(dt.date(2001, 1, 1)))
        .withColumn("total_minor", F.col("total_minor") + 100)
        .drop("issued_on")
    )
    return versions.merge_update(
        existing,
        incoming,
        ["org_id", "invoice_id"],
        ["status", "balance_minor", "paid_on"],
        [F.col("total_minor").desc()],
    )


# --- tenancy ----------------------------------------------------------------


@query(
    "tenant_scope",
    "P-7",
    sql="""SELECT org_id, source_record_type, COUNT(*) AS n, CAST(SUM(minor) AS BIGINT) AS total_minor FROM base WHERE org_id = 7 GROUP BY 1, 2""",
)
def tenant_scope(b):
    rows = predicates.analytical(tenancy.scoped(b.ledger, 7))
    return rows.groupBy("org_id", "source_record_type").agg(
        F.count("*").alias("n"), F.sum(minor("amount")).alias("total_minor")
    )


@query("tenant_own_row", "P-8", sql="SELECT n_nationkey AS org_id, n_name AS org_name FROM nation WHERE n_nationkey = 7", views=False)
def tenant_own_row(b):
    return tenancy.scoped(b.organizations, 7)


@query(
    "tenant_reach",
    "J-13",
    sql="""SELECT n_nationkey AS org_id, n_name AS org_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)""",
    views=False,
)
def tenant_reach(b):
    grants = b.table("supplier").where(F.col("s_acctbal") < 0).select(F.col("s_nationkey").alias("org_id"))
    return tenancy.reachable(b.organizations, grants, "org_id")


# --- search -----------------------------------------------------------------


@query(
    "transaction_search",
    "P-11",
    sql="""SELECT org_id, source_record_type, source_txn_id, occurred_at, CAST(amount * 100 AS BIGINT) AS amount_minor FROM ledger_c
WHERE is_canonical AND NOT is_voided AND direction = 'outflow' AND amount >= 50000 AND category IN ('Brand#2', 'Brand#3') AND occurred_at BETWEEN DATE '2000-08-01' AND DATE '2001-08-01'""",
)
def transaction_search(b):
    found = search.search(
        b.ledger,
        TTM.start,
        TTM.end,
        categories=("Brand#2", "Brand#3"),
        direction="outflow",
        min_minor=5_000_000,
        transfers=True,
    )
    return found.select(
        "org_id", "source_record_type", "source_txn_id", "occurred_at", minor("amount").alias("amount_minor")
    )


@query(
    "transaction_page",
    "O-8",
    sql="""SELECT org_id, occurred_at, source_record_type, source_txn_id, minor AS amount_minor FROM base WHERE occurred_at < DATE '2001-06-15'
OR (occurred_at = DATE '2001-06-15' AND (source_record_type > 'Invoice' OR (source_record_type = 'Invoice' AND source_txn_id > '5')))
ORDER BY occurred_at DESC, source_record_type, source_txn_id LIMIT 200""",
)
def transaction_page(b):
    rows = predicates.analytical(b.ledger).select(
        "org_id", "occurred_at", "source_record_type", "source_txn_id", minor("amount").alias("amount_minor")
    )
    return search.page_after(rows, (dt.date(2001, 6, 15), "Invoice", "5"), 200)


@query(
    "known_at_date",
    "P-12",
    sql=""", v AS (SELECT org_id, invoice_id, issued_on AS ingested_at, total_minor AS balance_minor FROM docs
UNION ALL SELECT org_id, invoice_id, paid_on, 0 FROM docs WHERE paid_on IS NOT NULL)
SELECT org_id, invoice_id, ingested_at, CAST(balance_minor AS BIGINT) AS balance_minor FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY org_id, invoice_id ORDER BY ingested_at DESC) AS rn
FROM v WHERE ingested_at <= DATE '2001-01-31') x WHERE rn = 1""",
)
def known_at_date(b):
    docs = b.invoices
    issued = docs.select("org_id", "invoice_id", F.col("issued_on").alias("ingested_at"), minor("total").alias("balance_minor"))
    settled = docs.where(F.col("paid_on").isNotNull()).select(
        "org_id", "invoice_id", F.col("paid_on").alias("ingested_at"), F.lit(0).cast("bigint").alias("balance_minor")
    )
    return predicates.known_at(
        issued.unionByName(settled), F.lit(dt.date(2001, 1, 31)), ["org_id", "invoice_id"]
    )


# --- sync bookkeeping -------------------------------------------------------


def connections(b):
    """Two connections per tenant and segment, from customers' balances and segments."""
    return b.table("customer").select(
        F.col("c_nationkey").cast("int").alias("org_id"),
        F.col("c_custkey").alias("connection_id"),
        F.lower("c_mktsegment").alias("source_kind"),
        F.when(F.col("c_acctbal") < 0, "reauth_required")
        .when(F.col("c_acctbal") > 9000, "degraded")
        .otherwise("active")
        .alias("status"),
        F.when(
            F.col("c_acctbal") > -500,
            F.to_timestamp(F.date_add(F.lit(dt.date(2001, 7, 1)), (F.col("c_custkey") % 30).cast("int"))),
        ).alias("last_successful_sync_at"),
        F.when(F.col("c_acctbal") > 9500, F.lit("2001-07-31 00:00:00").cast("timestamp")).alias("disconnected_at"),
    )


CONNECTIONS = """WITH conn AS (SELECT CAST(c_nationkey AS INT) AS org_id, c_custkey AS connection_id, lower(c_mktsegment) AS source_kind,
CASE WHEN c_acctbal < 0 THEN 'reauth_required' WHEN c_acctbal > 9000 THEN 'degraded' ELSE 'active' END AS status,
CASE WHEN c_acctbal > -500 THEN CAST(DATE '2001-07-01' + CAST(c_custkey % 30 AS INT) AS TIMESTAMP) END AS synced, c_acctbal > 9500 AS gone FROM customer)
"""


@query("live_connections", "P-9", sql=CONNECTIONS + "SELECT org_id, connection_id, source_kind, status FROM conn WHERE NOT gone", views=False)
def live_connections(b):
    return predicates.live_connections(connections(b)).select("org_id", "connection_id", "source_kind", "status")


@query(
    "connections_to_reauthorise",
    "P-9",
    sql=CONNECTIONS + "SELECT org_id, connection_id, source_kind, status FROM conn WHERE NOT gone AND status = 'reauth_required'",
    views=False,
)
def connections_to_reauthorise(b):
    return predicates.connections_to_reauthorise(connections(b)).select(
        "org_id", "connection_id", "source_kind", "status"
    )


@query(
    "data_freshness",
    "A-20",
    sql=CONNECTIONS
    + "SELECT org_id, source_kind, MAX(synced) AS last_sync_at, bool_or(status <> 'active') AS has_degraded_connection FROM conn WHERE NOT gone GROUP BY 1, 2",
    views=False,
)
def data_freshness(b):
    return quality.data_freshness(connections(b))


CANONICAL_COUNTS = """SELECT org_id, 'transactions' AS entity, COUNT(*) AS n FROM ledger_c GROUP BY 1
UNION ALL SELECT org_id, 'invoices', COUNT(*) FROM docs GROUP BY 1
UNION ALL SELECT org_id, 'customers', COUNT(*) FROM customers_c GROUP BY 1
UNION ALL SELECT CAST(p_partkey % 25 AS INT), 'accounts_needing_review', COUNT(*) FROM part WHERE p_size > 40 GROUP BY 1"""


@query("canonical_counts", "A-18", sql=CANONICAL_COUNTS)
def canonical_counts(b):
    return quality.canonical_counts(b.ledger, b.invoices, b.customers, part_accounts(b))


PROGRESS_PAGES = """WITH inv AS (SELECT 'conn-' || (o_custkey % 25) AS connection_id, o_orderkey // 500 AS page, o_orderstatus AS st FROM orders),
pages AS (SELECT connection_id, 'Invoice' AS record_type, page, 1 AS v, COUNT(*) AS n FROM inv GROUP BY ALL
UNION ALL SELECT connection_id, 'Invoice', page, 2, COUNT(*) FROM inv WHERE st = 'F' GROUP BY ALL
UNION ALL SELECT 'conn-' || (c_custkey % 25), 'Customer', c_custkey // 500, 1, COUNT(*) FROM customer GROUP BY ALL)
"""


def both_pages(b):
    return unique(b, "Invoice").unionByName(unique(b, "Customer"))


def checkpoints(b):
    """Backfill counters per connection and type; the counter counts retried pages again."""
    fetched = landing.with_page_facts(raw_books.pages(b, "Invoice").unionByName(raw_books.pages(b, "Customer")))
    seen = fetched.groupBy("connection_id", "record_type").agg(
        F.sum("record_count").cast("bigint").alias("records_seen")
    )
    pending = b.organizations.select(
        F.concat(F.lit("conn-"), F.col("org_id").cast("string")).alias("connection_id"),
        F.lit("Vendor").alias("record_type"),
        F.lit(0).cast("bigint").alias("records_seen"),
    )
    phase = F.when(F.col("record_type") == "Vendor", "backfill").otherwise("complete")
    return seen.unionByName(pending).withColumn("phase", phase)


@query(
    "sync_progress",
    "A-19",
    "J-5",
    sql=PROGRESS_PAGES
    + """SELECT connection_id, record_type, 'complete' AS phase, COUNT(*) AS pages, CAST(SUM(n) AS BIGINT) AS records_archived,
CAST(SUM(n) + SUM(CASE WHEN v = 1 AND page % 3 = 0 THEN n ELSE 0 END) AS BIGINT) AS records_seen FROM pages GROUP BY 1, 2
UNION ALL SELECT 'conn-' || n_nationkey, 'Vendor', 'backfill', 0, 0, 0 FROM nation""",
    views=False,
)
def sync_progress(b):
    return quality.sync_progress(checkpoints(b), both_pages(b))


@query(
    "count_reconciliation",
    "A-22",
    sql=PROGRESS_PAGES
    + """, ours AS (SELECT connection_id, record_type, CAST(SUM(n) AS BIGINT) AS n FROM pages GROUP BY 1, 2),
theirs AS (SELECT connection_id, 'Invoice' AS record_type, COUNT(*) AS n FROM inv GROUP BY 1
  UNION ALL SELECT 'conn-' || (s_suppkey % 25), 'Vendor', COUNT(*) FROM supplier GROUP BY 1)
SELECT COALESCE(o.connection_id, t.connection_id) AS connection_id, COALESCE(o.record_type, t.record_type) AS record_type, COALESCE(o.n, 0) AS our_count, t.n AS provider_count,
t.n IS NOT NULL AND t.n <> COALESCE(o.n, 0) AS divergent FROM ours o FULL JOIN theirs t ON o.connection_id = t.connection_id AND o.record_type = t.record_type""",
    views=False,
)
def count_reconciliation(b):
    keys = ["connection_id", "record_type"]
    ours = both_pages(b).groupBy(*keys).agg(F.sum("record_count").cast("bigint").alias("n"))

    def provider(table: str, column: str, kind: str):
        tenant = F.concat(F.lit("conn-"), (F.col(column) % 25).cast("string"))
        return b.table(table).groupBy(tenant.alias("connection_id")).agg(F.count("*").alias("n")).select(
            "connection_id", F.lit(kind).alias("record_type"), "n"
        )

    theirs = provider("orders", "o_custkey", "Invoice").unionByName(provider("supplier", "s_suppkey", "Vendor"))
    return quality.reconcile(ours, theirs, keys)


# --- snapshots, import, retention, export -----------------------------------


@query(
    "metric_snapshots",
    "S-12",
    sql=PNL + "\n" + "\nUNION ALL\n".join(metric_select(k) for k in METRIC_SQL),
)
def metric_snapshots(b):
    """Written twice, the second time for two metrics only, then read back: still one row per key."""
    path = fresh_path(b.spark, "metric-snapshots")
    table = metrics.metric_table(b.ledger, TTM, None, b.organizations)
    snapshots.write_metric_snapshots(table, path)
    again = metrics.metric_table(b.ledger, TTM, ["revenue", "cogs"], b.organizations)
    snapshots.write_metric_snapshots(again, path)
    return snapshots.read_metric_snapshots(b.spark, path, table.schema)


def order_file(b):
    """Orders as the text columns of a user's file, with money signs and some unreadable cells."""
    day = F.when(F.col("o_orderkey") % 89 == 1, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    money = F.concat(F.lit("$"), F.format_number(F.col("o_totalprice").cast("decimal(20,2)"), 2))
    rows = b.table("orders").select(
        (F.col("o_custkey") % 25).cast("string").alias("org"),
        F.col("o_orderkey").cast("string").alias("ref"),
        day.alias("when"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("-"), money)).otherwise(money).alias("value"),
        F.col("o_orderpriority").alias("memo"),
    )
    path = fresh_path(b.spark, "user-file")
    rows.write.option("header", True).option("escape", '"').csv(path)
    read = files.read_delimited(b.spark, path, rows.columns)
    return read.select(F.col("org").cast("int").alias("org_id"), "ref", "when", "value", "memo")


MAPPING = {"date": "when", "amount": "value", "description": "memo", "merchant": "ref"}


@query(
    "delimited_import",
    "S-14",
    sql="""SELECT CAST(o_custkey % 25 AS INT) AS org_id, 'Import' AS source_record_type, CASE WHEN o_orderstatus = 'O' THEN 'outflow' ELSE 'inflow' END AS direction,
CAST(ROUND(o_totalprice * 100) AS BIGINT) AS amount_minor, CAST(o_orderdate AS DATE) AS occurred_at, o_orderpriority AS description, CAST(o_orderkey AS VARCHAR) AS merchant_name FROM orders WHERE o_orderkey % 89 <> 1""",
    views=False,
)
def delimited_import(b):
    rows = files.import_delimited(order_file(b), MAPPING, "dd/MM/yyyy")
    return rows.select(
        "org_id",
        "source_record_type",
        "direction",
        minor("amount").alias("amount_minor"),
        "occurred_at",
        "description",
        "merchant_name",
    )


@query(
    "delimited_import_rejects",
    "S-14",
    sql="SELECT CAST(o_custkey % 25 AS INT) AS org_id, 'unreadable date' AS reason, COUNT(*) AS n FROM orders WHERE o_orderkey % 89 = 1 GROUP BY 1",
    views=False,
)
def delimited_import_rejects(b):
    rejects = files.import_rejects(order_file(b), MAPPING, "dd/MM/yyyy")
    return rejects.groupBy("org_id", "reason").agg(F.count("*").alias("n"))


@query(
    "retention_purge",
    "S-15",
    sql="""SELECT d.org_id, COUNT(*) AS n, MIN(issued_on) AS oldest, COUNT(CASE WHEN d.org_id NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) THEN c.name END) AS named_n
FROM docs d JOIN customers_c c ON c.customer_id = d.customer_id WHERE issued_on > DATE '1998-08-01' GROUP BY 1""",
)
def retention_purge(b):
    closed = b.table("supplier").where(F.col("s_acctbal") < 0).select(
        F.col("s_nationkey").alias("org_id"), F.lit(dt.date(2005, 6, 1)).alias("closed_on")
    )
    as_of = dt.date(2005, 8, 1)
    docs = b.invoices.join(b.customers, ["org_id", "customer_id"])
    kept = files.retained(docs, "financial", "issued_on", as_of)
    purged = files.without_personal_data(kept, closed, ["name"], as_of)
    return purged.groupBy("org_id").agg(
        F.count("*").alias("n"), F.min("issued_on").alias("oldest"), F.count("name").alias("named_n")
    )


@query(
    "tenant_export",
    "S-16",
    sql="""SELECT 'customers' AS name, COUNT(*) AS n FROM customers_c WHERE org_id = 7 UNION ALL SELECT 'invoices', COUNT(*) FROM docs WHERE org_id = 7
UNION ALL SELECT 'ledger', COUNT(*) FROM ledger_c WHERE org_id = 7""",
)
def tenant_export(b):
    path = fresh_path(b.spark, "tenant-export")
    tables = {"customers": b.customers, "invoices": b.invoices, "ledger": b.ledger}
    files.export_tenant(tables, 7, path)
    counts = [
        b.spark.read.schema(df.schema).parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        for name, df in tables.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "forecast_snapshots",
    "S-13",
    sql="""SELECT n_nationkey AS org_id, 91 AS points_n, 3 AS assumptions_n, DATE '2001-08-01' AS as_of FROM nation""",
    views=False,
)
def forecast_snapshots(b):
    from catalog.forecast import OPTIONS, inputs
    from centavo.plans.forecast import forecast_snapshot

    path = fresh_path(b.spark, "forecasts")
    facts = written(inputs(b, customers=True), "forecast-inputs")
    snapshots.append_forecasts(forecast_snapshot(facts, OPTIONS), path)
    rows = snapshots.latest_forecasts(b.spark, path)
    return rows.select(
        "org_id", F.size("points").alias("points_n"), F.size("assumptions").alias("assumptions_n"), "as_of"
    )
