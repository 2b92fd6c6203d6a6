"""Raw pages to canonical rows: landing facts, account mapping, documents, warnings."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import functions as F

from catalog import raw_books
from catalog.registry import query
from centavo.functions.money import minor
from centavo.operators import accounts as acc
from centavo.operators import normalize as nz
from centavo.operators.versions import latest_by
from centavo.sources import landing
from centavo.sources.books import AS_OF


def unique(b, record_type):
    return landing.unique_pages(raw_books.pages(b, record_type))


def records(b, record_type):
    return nz.latest_records(landing.unique_records(raw_books.pages(b, record_type)))


def mapped_accounts(b):
    return acc.normalize_accounts(records(b, "Account"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _matches(column: str, pattern: str) -> str:
    """A rule's pattern as SQL; a leading "without" part, which the SQL engine's patterns lack, as a test of its own."""
    without = re.fullmatch(r"\^\(\?!\.\*(.*?)\)\.\*(.*)", pattern)
    if without:
        return f"(regexp_matches({column}, '{without[2]}') AND NOT regexp_matches({column}, '{without[1]}'))"
    return f"regexp_matches({column}, '{pattern}')"


def _statement_case(value) -> str:
    rows = []
    for *patterns, statement, confidence in acc.STATEMENT_RULES:
        tests = [_matches(c, p) for c, p in zip(("sub", "typ", "nam"), patterns, strict=True) if p is not None]
        rows.append(f"WHEN {' AND '.join(tests)} THEN {value(statement, confidence)}")
    return "CASE " + "\n".join(rows)


STATEMENT_SQL = _statement_case(lambda statement, _: f"'{statement}'") + " END"
CONFIDENCE_SQL = _statement_case(lambda _, confidence: int(Decimal(confidence) * 1000)) + " ELSE 0 END"
CATEGORY_SQL = (
    "CASE "
    + "\n".join(
        f"WHEN st = '{statement}'{f' AND {_matches("nam", pattern)}' if pattern else ''} THEN '{category}'"
        for statement, pattern, category in acc.CATEGORY_RULES
    )
    + f" ELSE '{acc.UNCATEGORIZED}' END"
)

ACCOUNTS = f"""
, acct0 AS (SELECT CAST(p_partkey % 25 AS INT) AS org_id, CASE WHEN p_partkey % 211 <> 3 THEN CAST(p_partkey AS VARCHAR) END AS id,
  CASE WHEN p_partkey % 53 <> 5 THEN ({_list(raw_books.ACCOUNT_NAMES)})[p_partkey % 17 + 1] END AS raw_name,
  CASE WHEN p_partkey % 101 <> 7 THEN ({_list(raw_books.ACCOUNT_TYPES)})[p_partkey % 13 + 1] END AS t,
  CASE WHEN p_partkey % 7 = 0 THEN ({_list(raw_books.ACCOUNT_SUBTYPES)})[(p_partkey // 7) % 4 + 1] END AS s FROM part),
acct1 AS (SELECT *, lower(COALESCE(t, '')) AS typ, lower(COALESCE(s, '')) AS sub, lower(COALESCE(raw_name, '')) AS nam FROM acct0),
acct2 AS (SELECT *, {STATEMENT_SQL} AS st, {CONFIDENCE_SQL} AS conf FROM acct1),
acct AS (SELECT org_id, id, COALESCE(raw_name, 'Account ' || id) AS name, COALESCE(t, '') AS t, COALESCE(s, '') AS s, st,
  {CATEGORY_SQL} AS cat, conf, st IS NULL OR conf < 700 AS review, raw_name, t AS raw_t FROM acct2)
"""


def milli(column: str):
    return (F.col(column) * 1000).cast("int")


@query(
    "account_mapping",
    "N-1",
    "N-2",
    "N-3",
    "F-10",
    sql=ACCOUNTS
    + """SELECT org_id, id AS source_account_id, name, t AS account_type, s AS account_subtype, st AS statement, cat AS category_key,
CAST(conf AS INT) AS confidence_milli, review AS needs_review FROM acct WHERE id IS NOT NULL""",
)
def account_mapping(b):
    return mapped_accounts(b).withColumn("confidence_milli", milli("mapping_confidence")).drop("mapping_confidence")


@query(
    "account_warnings",
    "N-13",
    sql=ACCOUNTS
    + """SELECT org_id, CASE WHEN id IS NULL THEN 'missing_field' WHEN st IS NULL THEN 'unmapped_account' ELSE 'ambiguous_account' END AS kind,
CASE WHEN id IS NULL THEN 'Account without Id' WHEN st IS NULL THEN COALESCE(raw_name, id) || ' (' || COALESCE(raw_t, 'no type') || ') has no class'
ELSE COALESCE(raw_name, id) || ' mapped to ' || st || ' at ' || CAST(conf // 10 AS VARCHAR) || '%' END AS detail, id AS source_id
FROM acct WHERE id IS NULL OR review""",
)
def account_warnings(b):
    return acc.account_warnings(records(b, "Account"))


DOCS = (
    ACCOUNTS
    + """
, li AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber) - 1 AS i FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) x WHERE rn = 1),
heads AS (SELECT l_orderkey AS k, l_linestatus AS ls, MIN(CAST(l_shipdate AS DATE)) AS day, MIN(l_suppkey) AS party,
  SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS total FROM li GROUP BY 1, 2),
lines AS (
  SELECT h.k, h.ls, h.day, CAST(h.k AS VARCHAR) || ':' || CAST(li.i AS VARCHAR) AS txn, CAST(ROUND(li.l_extendedprice * 100) AS BIGINT) AS m,
    CASE WHEN li.l_linenumber % 2 = 0 THEN 'Line ' || CAST(li.l_linenumber AS VARCHAR) END AS descr,
    CASE WHEN li.l_partkey % 37 = 0 THEN NULL WHEN li.l_partkey % 41 = 0 THEN '999999999' ELSE CAST(li.l_partkey - li.l_partkey % 25 + h.k % 25 AS VARCHAR) END AS aid, h.party, FALSE AS header
  FROM heads h JOIN li ON li.l_orderkey = h.k AND li.l_linestatus = h.ls WHERE h.k % 29 <> 0 AND h.k % 503 <> 9
  UNION ALL SELECT k, ls, day, CAST(k AS VARCHAR), total, NULL, NULL, party, TRUE FROM heads WHERE k % 29 = 0 AND k % 503 <> 9),
exp AS (
  SELECT CAST(l.k % 25 AS INT) AS org_id, l.txn AS source_txn_id, CASE ls WHEN 'F' THEN 'Purchase' ELSE 'Bill' END AS source_record_type, 'outflow' AS direction, l.m AS amount_minor,
    l.day AS occurred_at, CASE WHEN ls = 'F' THEN l.day END AS posted_at, l.descr AS description,
    COALESCE(CASE WHEN l.k % 4 <> 0 THEN printf('Supplier#%09d', l.party) END, a.name) AS merchant_name, l.aid AS source_account_id, CAST(NULL AS VARCHAR) AS source_customer_id, a.st AS statement,
    CASE WHEN header THEN 'opex.other' ELSE COALESCE(a.cat, 'uncategorized') END AS category_key,
    CASE WHEN a.st IS NULL THEN 'default' ELSE 'source_system' END AS category_source, CAST(CASE WHEN a.st IS NULL THEN 0 ELSE 900 END AS INT) AS confidence_milli
  FROM lines l LEFT JOIN acct a ON a.id = l.aid AND a.org_id = l.k % 25),
ord AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, CAST(o_custkey % 25 AS INT) AS org_id, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS m, CAST(o_orderdate AS DATE) AS day,
  CASE WHEN o_custkey % 6 <> 0 THEN printf('Customer#%09d', o_custkey) END AS party, CASE WHEN o_custkey % 3 = 0 THEN 15 ELSE 30 END AS terms,
  CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'P' THEN CAST(ROUND(CAST(o_totalprice AS DECIMAL(20,6)) * 0.5, 2) * 100 AS BIGINT) ELSE CAST(ROUND(o_totalprice * 100) AS BIGINT) END AS bal FROM orders),
inv0 AS (SELECT * FROM ord WHERE k % 503 <> 9 AND k % 401 <> 11 AND k % 199 <> 13),
pay AS (SELECT org_id, CAST(k AS VARCHAR) AS source_txn_id, 'Payment' AS source_record_type, 'inflow' AS direction, m AS amount_minor, CAST(day + 40 AS DATE) AS occurred_at, CAST(day + 40 AS DATE) AS posted_at,
  COALESCE('Payment: ' || party, 'Customer payment') AS description, party AS merchant_name, CAST(NULL AS VARCHAR) AS source_account_id, CAST(c AS VARCHAR) AS source_customer_id, 'asset' AS statement,
  'uncategorized' AS category_key, 'source_system' AS category_source, 950 AS confidence_milli FROM ord WHERE st = 'F' AND k % 601 <> 15 AND k % 701 <> 17),
rev AS (SELECT org_id, CAST(k AS VARCHAR) AS source_txn_id, 'Invoice' AS source_record_type, 'inflow' AS direction, m AS amount_minor, day AS occurred_at, CAST(NULL AS DATE) AS posted_at,
  COALESCE('Invoice: ' || party, 'Invoice') AS description, party AS merchant_name, CAST(NULL AS VARCHAR) AS source_account_id, CAST(c AS VARCHAR) AS source_customer_id, 'revenue' AS statement,
  'revenue.services' AS category_key, 'source_system' AS category_source, 950 AS confidence_milli FROM inv0)
"""
)


def shown(df):
    return (
        df.withColumn("amount_minor", minor("amount"))
        .withColumn("confidence_milli", milli("category_confidence"))
        .drop("amount", "category_confidence", "is_canonical", "is_transfer", "is_voided", "transform_version")
    )


def purchases(b):
    return nz.normalize_expenses(records(b, "Purchase"), "Purchase", mapped_accounts(b))


def bills(b):
    return nz.normalize_expenses(records(b, "Bill"), "Bill", mapped_accounts(b))


@query("purchase_lines", "N-5", "N-11", "J-7", sql=DOCS + "SELECT * FROM exp WHERE source_record_type = 'Purchase'")
def purchase_lines(b):
    return shown(purchases(b))


@query("bill_lines", "N-5", "N-11", "J-7", sql=DOCS + "SELECT * FROM exp WHERE source_record_type = 'Bill'")
def bill_lines(b):
    return shown(bills(b))


@query("payment_inflows", "N-6", sql=DOCS + "SELECT * FROM pay")
def payment_inflows(b):
    return shown(nz.normalize_payments(records(b, "Payment")))


@query("invoice_revenue", "N-7", sql=DOCS + "SELECT * FROM rev")
def invoice_revenue(b):
    return shown(nz.invoice_revenue(records(b, "Invoice")))


@query(
    "invoice_documents",
    "N-7",
    "N-8",
    "N-14",
    sql=DOCS
    + """, x AS (SELECT *, CASE WHEN k % 97 <> 0 THEN CAST(day + terms AS DATE) END AS due FROM inv0)
SELECT org_id, CAST(k AS VARCHAR) AS source_invoice_id, 'INV-' || k AS number, CAST(c AS VARCHAR) AS source_customer_id, day AS issued_on, due AS due_date, CAST(terms AS INT) AS terms_days,
m AS total_minor, CAST(bal AS BIGINT) AS balance_minor, CASE WHEN bal = 0 THEN 'paid' WHEN due < DATE '2001-08-01' THEN 'overdue' WHEN bal < m THEN 'partial' ELSE 'open' END AS status,
CASE WHEN bal = 0 THEN CAST(CASE WHEN st = 'F' THEN day + 40 ELSE day END AS DATE) END AS paid_on FROM x""",
)
def invoice_documents(b):
    out = nz.normalize_invoices(records(b, "Invoice"), AS_OF)
    return (
        out.withColumn("total_minor", minor("total"))
        .withColumn("balance_minor", minor("balance"))
        .drop("total", "balance")
    )


@query(
    "normalized_customers",
    "N-9",
    "N-10",
    sql="""SELECT CAST(c_custkey % 25 AS INT) AS org_id, CAST(c_custkey AS VARCHAR) AS source_customer_id, CASE WHEN c_custkey % 41 <> 6 THEN c_name ELSE 'Unknown' END AS name,
CASE WHEN c_custkey % 4 <> 0 THEN 'billing' || c_custkey || '@example.com' END AS email,
regexp_replace(lower(CASE WHEN c_custkey % 41 <> 6 THEN c_name ELSE 'Unknown' END), '[^a-z0-9]', '', 'g') AS normalized_name FROM customer WHERE c_custkey % 307 <> 4""",
    views=False,
)
def normalized_customers(b):
    return nz.normalize_customers(records(b, "Customer"))


@query(
    "document_warnings",
    "N-13",
    "N-4",
    sql=DOCS
    + """SELECT org_id, 'missing_field' AS kind, 'Invoice missing Id or TxnDate' AS detail, CAST(NULL AS VARCHAR) AS source_id FROM ord WHERE k % 503 <> 9 AND k % 401 = 11
UNION ALL SELECT org_id, 'missing_field', 'Invoice missing Id or TxnDate', NULL FROM ord WHERE k % 503 = 9
UNION ALL SELECT org_id, 'missing_field', 'Invoice missing Id or TxnDate', NULL FROM ord WHERE k % 503 = 9 AND st = 'F'
UNION ALL SELECT org_id, 'unparseable_amount', 'Amount ' || CAST(o_totalprice AS VARCHAR), CAST(k AS VARCHAR) FROM ord JOIN orders ON o_orderkey = k WHERE k % 503 <> 9 AND k % 401 <> 11 AND k % 199 = 13
UNION ALL SELECT org_id, 'missing_field', 'Payment missing Id or TxnDate', NULL FROM ord WHERE st = 'F' AND k % 601 = 15
UNION ALL SELECT org_id, 'unparseable_amount', 'Amount missing', CAST(k AS VARCHAR) FROM ord WHERE st = 'F' AND k % 601 <> 15 AND k % 701 = 17
UNION ALL SELECT CAST(k % 25 AS INT), 'missing_field', CASE ls WHEN 'F' THEN 'Purchase' ELSE 'Bill' END || ' missing Id or TxnDate', NULL FROM heads WHERE k % 503 = 9""",
)
def document_warnings(b):
    return nz.all_transactions(
        [nz.document_warnings(records(b, kind), kind) for kind in ("Invoice", "Payment", "Purchase", "Bill")]
    )


@query(
    "amount_parsing",
    "N-4",
    sql=DOCS
    + """SELECT org_id, COUNT(CASE WHEN k % 199 <> 13 THEN 1 END) AS accepted_n, CAST(COALESCE(SUM(CASE WHEN k % 199 <> 13 THEN m END), 0) AS BIGINT) AS accepted_minor,
COUNT(CASE WHEN k % 199 = 13 THEN 1 END) AS refused_n FROM ord WHERE k % 503 <> 9 GROUP BY 1""",
)
def amount_parsing(b):
    rows = records(b, "Invoice").where(nz.text("Id").isNotNull()).select("org_id", nz.amount("TotalAmt").alias("a"))
    return rows.groupBy("org_id").agg(
        F.count("a").alias("accepted_n"),
        F.coalesce(F.sum(minor("a")), F.lit(0).cast("bigint")).alias("accepted_minor"),
        F.count(F.when(F.col("a").isNull(), 1)).alias("refused_n"),
    )


@query(
    "all_transactions",
    "U-1",
    sql=DOCS
    + """, u AS (SELECT * FROM exp UNION ALL SELECT * FROM pay UNION ALL SELECT * FROM rev)
SELECT org_id, source_record_type, statement, COUNT(*) AS n, CAST(SUM(amount_minor) AS BIGINT) AS total_minor FROM u GROUP BY 1, 2, 3""",
)
def all_transactions(b):
    both = nz.all_transactions(
        [
            nz.invoice_revenue(records(b, "Invoice")),
            nz.normalize_payments(records(b, "Payment")),
            purchases(b),
            bills(b),
        ]
    )
    return both.groupBy("org_id", "source_record_type", "statement").agg(
        F.count("*").alias("n"), F.sum(minor("amount")).alias("total_minor")
    )


def tenant_categories(b):
    """System rows plus one row of its own per tenant and brand it uses."""
    own = b.table("part").select(
        (F.col("p_partkey") % 25).cast("int").alias("org_id"),
        F.concat(F.lit("own."), F.lower("p_brand")).alias("key"),
        F.col("p_brand").alias("name"),
        F.lit("opex").alias("statement"),
        F.lit(False).alias("is_discretionary"),
    )
    return acc.system_categories(b.spark).unionByName(own.dropDuplicates(["org_id", "key"]))


TAXONOMY = ", ".join(
    f"('{key}', '{name}', '{statement}', {str(flag).upper()})" for key, name, statement, flag in acc.SYSTEM_CATEGORIES
)


@query(
    "category_dimension",
    "S-10",
    "P-8",
    sql=f"""SELECT CAST(NULL AS INT) AS org_id, key, name, statement, is_discretionary, sha256('system|' || key) AS category_id FROM (VALUES {TAXONOMY}) t(key, name, statement, is_discretionary)
UNION ALL SELECT DISTINCT CAST(7 AS INT), 'own.' || lower(p_brand), p_brand, 'opex', FALSE, sha256('7|own.' || lower(p_brand)) FROM part WHERE p_partkey % 25 = 7""",
    views=False,
)
def category_dimension(b):
    from centavo.operators.tenancy import scoped_with_shared

    return acc.category_lookup(scoped_with_shared(tenant_categories(b), 7))


@query(
    "key_resolution",
    "N-12",
    sql=DOCS
    + """, u AS (SELECT * FROM exp UNION ALL SELECT * FROM pay UNION ALL SELECT * FROM rev),
c AS (SELECT c_custkey % 25 AS org_id, CAST(c_custkey AS VARCHAR) AS cid FROM customer WHERE c_custkey % 307 <> 4)
SELECT u.org_id, u.source_record_type, COUNT(*) AS n, COUNT(a.id) AS with_account, COUNT(c.cid) AS with_customer,
COUNT(CASE WHEN category_key IS NOT NULL THEN 1 END) AS with_category, MIN(sha256('{"_0":"' || CAST(u.org_id AS VARCHAR) || '","_1":"' || a.id || '"}')) AS first_account_id FROM u
LEFT JOIN acct a ON a.org_id = u.org_id AND a.id = u.source_account_id LEFT JOIN c ON c.org_id = u.org_id AND c.cid = u.source_customer_id GROUP BY 1, 2""",
)
def key_resolution(b):
    rows = nz.all_transactions(
        [nz.invoice_revenue(records(b, "Invoice")), nz.normalize_payments(records(b, "Payment")), purchases(b), bills(b)]
    )
    customers = nz.normalize_customers(records(b, "Customer"))
    resolved = nz.resolve_keys(rows, mapped_accounts(b), customers, acc.category_lookup(tenant_categories(b)))
    return resolved.groupBy("org_id", "source_record_type").agg(
        F.count("*").alias("n"),
        F.count("ledger_account_id").alias("with_account"),
        F.count("customer_id").alias("with_customer"),
        F.count("category_id").alias("with_category"),
        F.min("ledger_account_id").alias("first_account_id"),
    )


PAGES = """, keys AS (SELECT CAST(o_custkey % 25 AS INT) AS org_id, CAST(o_orderkey // 500 AS INT) AS page_index, o_orderstatus AS st FROM orders),
p1 AS (SELECT org_id, page_index, COUNT(*) AS n, TIMESTAMP '2001-07-20 00:00:00' AS fetched_at FROM keys GROUP BY 1, 2),
p2 AS (SELECT org_id, CAST(page_index + 1000000 AS INT) AS page_index, COUNT(*) AS n, TIMESTAMP '2001-07-30 00:00:00' AS fetched_at FROM keys WHERE st = 'F' GROUP BY 1, 2),
again AS (SELECT org_id, page_index, n FROM p1 WHERE page_index % 3 = 0),
up AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2)
"""


@query(
    "page_dedup",
    "S-3",
    "A-29",
    "U-2",
    sql=PAGES
    + """SELECT u.org_id, 'Invoice' AS record_type, COUNT(*) + COALESCE(MAX(a.c), 0) AS pages_fetched, COUNT(*) AS pages_unique, CAST(SUM(n) AS BIGINT) AS records_archived
FROM up u LEFT JOIN (SELECT org_id, COUNT(*) AS c FROM again GROUP BY 1) a ON a.org_id = u.org_id GROUP BY 1""",
)
def page_dedup(b):
    pages = landing.with_page_facts(raw_books.pages(b, "Invoice"))
    key = ["org_id", "record_type"]
    per_hash = pages.groupBy(*key, "connection_id", "content_hash").agg(
        F.count("*").alias("fetched"), F.max("record_count").cast("bigint").alias("record_count")
    )
    return per_hash.groupBy(*key).agg(
        F.sum("fetched").alias("pages_fetched"),
        F.count("*").alias("pages_unique"),
        F.sum("record_count").alias("records_archived"),
    )


@query(
    "page_listing",
    "S-11",
    "S-1",
    sql=PAGES
    + """SELECT org_id, 'conn-' || org_id AS connection_id, 'Invoice' AS record_type, page_index, fetched_at, CAST(n AS INT) AS record_count, rank FROM (
SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY org_id ORDER BY fetched_at DESC, page_index) AS INT) AS rank FROM up) x WHERE rank <= 50""",
)
def page_listing(b):
    return landing.list_pages(unique(b, "Invoice")).drop("object_key", "content_hash")


@query(
    "record_replay",
    "S-2",
    sql=PAGES + "SELECT org_id, 'Invoice' AS record_type, CAST(SUM(n) AS BIGINT) AS records FROM up GROUP BY 1",
)
def record_replay(b):
    rows = landing.unique_records(raw_books.pages(b, "Invoice"))
    return rows.groupBy("org_id", "record_type").agg(F.count("*").alias("records"))


@query(
    "incremental_extract",
    "S-4",
    "T-3",
    sql=DOCS
    + """SELECT org_id, CAST(k AS VARCHAR) AS id, CAST(day + 40 AS DATE) AS updated_on FROM ord WHERE st = 'F' AND day + 40 >= DATE '2001-07-25' AND k % 503 <> 9
UNION ALL SELECT org_id, CAST(k AS VARCHAR), day FROM ord WHERE st <> 'F' AND day >= DATE '2001-07-25' AND k % 503 <> 9""",
)
def incremental_extract(b):
    rows = records(b, "Invoice").where(nz.text("Id").isNotNull())
    since = F.lit("2001-07-25 00:00:00").cast("timestamp")
    return landing.updated_since(rows, since).select(
        "org_id", nz.text("Id").alias("id"), F.to_date("updated_at").alias("updated_on")
    )


@query(
    "record_sample",
    "O-11",
    sql="""SELECT org_id, id, rank FROM (SELECT CAST(o_custkey % 25 AS INT) AS org_id, CAST(o_orderkey AS VARCHAR) AS id,
CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey % 25 ORDER BY CAST(o_orderkey AS VARCHAR)) AS INT) AS rank FROM orders WHERE o_orderkey % 503 <> 9) x WHERE rank <= 3""",
    views=False,
)
def record_sample(b):
    from centavo.operators.versions import top_per

    ids = records(b, "Invoice").select("org_id", nz.text("Id").alias("id")).where(F.col("id").isNotNull())
    return top_per(ids, ["org_id"], [F.col("id")], 3)


@query(
    "latest_invoice_version",
    "N-14",
    sql=DOCS
    + """SELECT org_id, CAST(k AS VARCHAR) AS id, CAST(bal AS BIGINT) AS balance_minor FROM ord WHERE k % 503 <> 9""",
)
def latest_invoice_version(b):
    return (
        records(b, "Invoice")
        .where(nz.text("Id").isNotNull())
        .select("org_id", nz.text("Id").alias("id"), minor(nz.amount("Balance")).alias("balance_minor"))
    )


@query(
    "field_coverage",
    "A-21",
    "O-7",
    sql="""SELECT org_id, field, COUNT(*) AS n, FLOOR(CAST(COUNT(*) AS DOUBLE) / MAX(t) * 100 + 0.5) AS coverage_pct FROM (
SELECT CAST(c_custkey % 25 AS INT) AS org_id, UNNEST([CASE WHEN c_custkey % 307 <> 4 THEN 'Id' END, CASE WHEN c_custkey % 41 <> 6 THEN 'DisplayName' END, CASE WHEN c_custkey % 4 <> 0 THEN 'PrimaryEmailAddr' END]) AS field,
COUNT(*) OVER (PARTITION BY c_custkey % 25) AS t FROM customer) x WHERE field IS NOT NULL GROUP BY 1, 2""",
    views=False,
)
def field_coverage(b):
    from centavo.operators.quality import field_coverage

    return field_coverage(landing.unique_records(raw_books.pages(b, "Customer")), ["org_id"])
