"""Registration of named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from centavo.sources.books import Books

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ROWS: dict[str, tuple[str, ...]] = {}

VIEWS = """WITH customers_c AS (
SELECT c_custkey AS customer_id, CAST(c_nationkey AS INT) AS org_id, c_name AS name FROM customer
), invoices_c AS (
SELECT o.o_orderkey AS invoice_id, CAST(c.c_nationkey AS INT) AS org_id, o.o_custkey AS customer_id,
       o.issued_on, o.due_date, o.total,
       CASE WHEN o.o_orderstatus = 'F' AND o.pay_date <= DATE '2001-08-01' THEN o.pay_date END AS paid_on,
       CASE WHEN o.o_orderstatus = 'F' AND o.pay_date <= DATE '2001-08-01' THEN CAST(0 AS DECIMAL(20,4))
            WHEN o.o_orderstatus = 'P' THEN CAST(ROUND(o.total * 0.5, 2) AS DECIMAL(20,4))
            ELSE o.total END AS balance
FROM (SELECT *, due_date + CAST(o_custkey % 40 - 3 + o_orderkey % 7 AS INT) AS pay_date
      FROM (SELECT *, CAST(o_orderdate AS DATE) AS issued_on,
                   CASE WHEN o_orderkey % 97 <> 0
                        THEN CAST(o_orderdate AS DATE) + CASE WHEN o_custkey % 3 = 0 THEN 15 ELSE 30 END END AS due_date,
                   CAST(ROUND(CAST(o_totalprice AS DECIMAL(20,6)), 2) AS DECIMAL(20,4)) AS total
            FROM orders) a) o
JOIN customer c ON c.c_custkey = o.o_custkey
), expenses_c AS MATERIALIZED (
SELECT CONCAT(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING)) AS source_txn_id,
       CAST(s_nationkey AS INT) AS org_id, CAST(l_shipdate AS DATE) AS occurred_at,
       CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS posted_at,
       CAST(l_extendedprice AS DECIMAL(20,4)) AS amount,
       CASE p_type WHEN 'STANDARD' THEN 'opex' WHEN 'MEDIUM' THEN 'opex' WHEN 'SMALL' THEN 'payroll'
                   WHEN 'LARGE' THEN 'cogs' WHEN 'ECONOMY' THEN 'cogs' END AS statement,
       CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS category,
       CASE WHEN l_quantity >= 5 THEN s_name END AS merchant_name,
       NOT (l_returnflag = 'A' AND l_tax = 0) AS is_canonical,
       (l_returnflag = 'N' AND l_discount = 0) AS is_transfer,
       (l_returnflag = 'R' AND l_discount >= 0.095) AS is_voided
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
             ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn
      FROM lineitem) l
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE rn = 1
), ledger_c AS MATERIALIZED (
SELECT org_id, source_txn_id, CASE WHEN posted_at IS NOT NULL THEN 'Purchase' ELSE 'Bill' END AS source_record_type, 'outflow' AS direction,
       amount, occurred_at, posted_at, merchant_name, category, statement, CAST(NULL AS BIGINT) AS customer_id, is_canonical, is_transfer, is_voided
FROM expenses_c
UNION ALL
SELECT org_id, CAST(invoice_id AS STRING), 'Invoice', 'inflow', total, issued_on, CAST(NULL AS DATE), CAST(NULL AS STRING), CAST(NULL AS STRING),
       'revenue', customer_id, TRUE, FALSE, FALSE FROM invoices_c
UNION ALL
SELECT org_id, CAST(invoice_id AS STRING), 'Payment', 'inflow', total, paid_on, paid_on, CAST(NULL AS STRING), CAST(NULL AS STRING),
       'asset', customer_id, TRUE, FALSE, FALSE FROM invoices_c WHERE paid_on IS NOT NULL
), base AS MATERIALIZED (
SELECT *, CAST(amount * 100 AS BIGINT) AS minor, CASE WHEN direction = 'inflow' THEN 1 ELSE -1 END * CAST(amount * 100 AS BIGINT) AS flow,
       COALESCE(category, 'Uncategorized') AS label
FROM ledger_c WHERE is_canonical AND NOT is_transfer AND NOT is_voided
), docs AS (
SELECT *, CAST(total * 100 AS BIGINT) AS total_minor, CAST(balance * 100 AS BIGINT) AS balance_minor,
       CASE WHEN balance = 0 THEN 'paid' WHEN due_date < DATE '2001-08-01' THEN 'overdue'
            WHEN balance < total THEN 'partial' ELSE 'open' END AS status
FROM invoices_c
)"""


def query(name: str, *rows: str, sql: str | None = None, views: bool = True):
    """Register `fn(books)` under `name`.

    `sql` is a SELECT over the canonical views, or starts with a comma to add
    more named subqueries first. `views=False` marks SQL that stands alone.
    """

    def add(fn: Callable[[Books], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, path: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Books(spark, path, stored=True))

        QUERIES[name] = run
        ROWS[name] = rows
        if sql is not None:
            text = sql.strip()
            ORACLE[name] = (f"{VIEWS}{text}" if text.startswith(",") else f"{VIEWS}\n{text}") if views else text
        return fn

    return add
