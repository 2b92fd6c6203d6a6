"""Canonical books read from an order-management star schema.

Tenants are nations. Customers' orders become invoices and payments, suppliers'
line items become bills and purchases.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from centavo.operators.documents import document_status
from centavo.operators.versions import latest_by
from centavo.session import fresh_path, written
from centavo.sources.ledger import LedgerTable, buckets_for, fingerprint

AS_OF = dt.date(2001, 8, 1)

# Part type to statement class; other types carry none.
PART_STATEMENT = {
    "STANDARD": "opex",
    "MEDIUM": "opex",
    "SMALL": "payroll",
    "LARGE": "cogs",
    "ECONOMY": "cogs",
}


# Tables that the ledger is made of.
LEDGER_TABLES = ("lineitem", "part", "supplier", "orders", "customer")

# Kinds of ledger rows, and the columns of a row before it is written out in full.
BILL, PURCHASE, INVOICE, PAYMENT = range(4)
SLIM = (
    "org_id",
    "kind",
    "key",
    "line",
    "amount",
    "occurred_at",
    "merchant_name",
    "category",
    "statement",
    "customer_id",
    "is_canonical",
    "is_transfer",
    "is_voided",
)

_SCHEMAS: dict[str, StructType] = {}
_LEDGERS: dict[tuple, LedgerTable] = {}
_LANDED: dict[tuple, DataFrame] = {}


@dataclass(frozen=True)
class Books:
    """Lazy canonical frames over one directory of Parquet tables."""

    spark: SparkSession
    path: str
    as_of: dt.date = AS_OF
    #: read the ledger from its stored table, written when it is first asked for
    stored: bool = False

    def table(self, name: str) -> DataFrame:
        """A given table. Its schema is read from the file footer once per process."""
        file = f"{self.path}/{name}.parquet"
        if file not in _SCHEMAS:
            _SCHEMAS[file] = self.spark.read.parquet(file).schema
        return self.spark.read.schema(_SCHEMAS[file]).parquet(file)

    @property
    def organizations(self) -> DataFrame:
        return self.table("nation").selectExpr("n_nationkey AS org_id", "n_name AS org_name")

    @property
    def customers(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "CAST(c_nationkey AS INT) AS org_id", "c_custkey AS customer_id", "c_name AS name"
        )

    @property
    def vendors(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "CAST(s_nationkey AS INT) AS org_id", "s_suppkey AS vendor_id", "s_name AS name"
        )

    @property
    def invoices(self) -> DataFrame:
        """Orders as invoices; finished orders are paid a customer-specific number of days after the due date."""
        as_of = f"DATE '{self.as_of}'"
        orders = self.table("orders").selectExpr(
            "o_orderkey AS invoice_id",
            "o_custkey AS customer_id",
            "o_orderstatus AS state",
            "CAST(o_orderdate AS DATE) AS issued_on",
            """CASE WHEN o_orderkey % 97 <> 0
               THEN date_add(CAST(o_orderdate AS DATE), IF(o_custkey % 3 = 0, 15, 30)) END AS due_date""",
            "CAST(round(CAST(o_totalprice AS DECIMAL(20,6)), 2) AS DECIMAL(20,4)) AS total",
        )
        dated = orders.join(self.customers.select("org_id", "customer_id"), "customer_id").selectExpr(
            "*", "date_add(due_date, CAST(customer_id % 40 - 3 + invoice_id % 7 AS INT)) AS pay_date"
        )
        settled = f"state = 'F' AND pay_date <= {as_of}"
        billed = dated.selectExpr(
            "org_id",
            "invoice_id",
            "customer_id",
            "issued_on",
            "due_date",
            "total",
            f"CASE WHEN {settled} THEN pay_date END AS paid_on",
            f"""CASE WHEN {settled} THEN CAST(0 AS DECIMAL(20,4))
                WHEN state = 'P' THEN CAST(round(total * 0.5, 2) AS DECIMAL(20,4)) ELSE total END AS balance""",
        )
        status = document_status(F.col("total"), F.col("balance"), F.col("due_date"), self.as_of)
        return billed.withColumn("status", status)

    @property
    def line_items(self) -> DataFrame:
        """One row per order line: a line key may repeat, the first by content is kept.

        Lines are dealt by key first. A rank over undealt rows is also limited in every input task, which would sort the whole
        table once more before its shuffle, beyond memory where a file is large.
        """
        order = (
            "l_shipdate",
            "l_partkey",
            "l_suppkey",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            "l_returnflag",
            "l_linestatus",
        )
        keys = ["l_orderkey", "l_linenumber"]
        return latest_by(self.table("lineitem").repartition(*keys), keys, [F.col(c) for c in order])

    @property
    def expenses(self) -> DataFrame:
        """Order lines as bills and, where the line is finished, purchases."""
        return _ledger_rows(self._slim_expenses)

    @property
    def _slim_expenses(self) -> DataFrame:
        """Expenses without what follows from their kind; a line is cut to what they need before it is joined."""
        classes = " ".join(f"WHEN '{kind}' THEN '{statement}'" for kind, statement in PART_STATEMENT.items())
        parts = self.table("part").selectExpr(
            "p_partkey AS l_partkey",
            f"CASE p_type {classes} END AS statement",
            "CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS category",
        )
        suppliers = self.table("supplier").selectExpr(
            "s_suppkey AS l_suppkey", "CAST(s_nationkey AS INT) AS org_id", "s_name"
        )
        lines = self.line_items.selectExpr(
            "l_orderkey AS key",
            "l_linenumber AS line",
            "l_partkey",
            "l_suppkey",
            f"CAST(IF(l_linestatus = 'F', {PURCHASE}, {BILL}) AS TINYINT) AS kind",
            "l_extendedprice AS price",
            "CAST(l_shipdate AS DATE) AS occurred_at",
            "l_quantity >= 5 AS has_name",
            "NOT (l_returnflag = 'A' AND l_tax = 0) AS is_canonical",
            "(l_returnflag = 'N' AND l_discount = 0) AS is_transfer",
            "(l_returnflag = 'R' AND l_discount >= 0.095D) AS is_voided",
        )
        return (
            lines.join(parts, "l_partkey")
            .join(suppliers, "l_suppkey")
            .selectExpr(
                "org_id",
                "kind",
                "key",
                "line",
                "CAST(price AS DECIMAL(20,4)) AS amount",
                "occurred_at",
                "CASE WHEN has_name THEN s_name END AS merchant_name",
                "category",
                "statement",
                "CAST(NULL AS BIGINT) AS customer_id",
                "is_canonical",
                "is_transfer",
                "is_voided",
            )
        )

    @property
    def ledger(self) -> DataFrame:
        """Bills and purchases, invoices as accrual revenue, payments as cash received."""
        return self.ledger_table.read() if self.stored else self.computed_ledger

    @cached_property
    def ledger_table(self) -> LedgerTable:
        """The stored ledger of these tables. It is written once, and anew when one of their files has changed."""
        key = (*self._given, self.as_of)
        if key not in _LEDGERS:
            slim = self._slim_ledger
            table = LedgerTable(self.spark, fresh_path(self.spark, "ledger"), _ledger_rows(slim).schema, buckets_for(self._given[-1]))
            table.load(slim, _ledger_rows)
            _LEDGERS[key] = table
        return _LEDGERS[key]

    @cached_property
    def _given(self) -> tuple:
        """The application, the tables, a mark of their present files, and their bytes."""
        mark, size = fingerprint(self.spark, [f"{self.path}/{name}.parquet" for name in LEDGER_TABLES])
        return self.spark.sparkContext.applicationId, self.path, mark, size

    def landed(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A frame made from these tables, written once as if it had been landed; anew when one of their files has changed."""
        key = (*self._given, name)
        if key not in _LANDED:
            _LANDED[key] = written(make(), f"landed-{name}")
        return _LANDED[key]

    @property
    def computed_ledger(self) -> DataFrame:
        """The ledger from the given tables; every line key occurs once in it, and every invoice."""
        return _ledger_rows(self._slim_ledger)

    @property
    def _slim_ledger(self) -> DataFrame:
        """The rows of the ledger without what follows from their kind."""
        invoices = self.invoices

        def inflow(kind: int, statement: str, occurred: str) -> list[str]:
            return [
                "org_id",
                f"CAST({kind} AS TINYINT) AS kind",
                "invoice_id AS key",
                "CAST(NULL AS INT) AS line",
                "total AS amount",
                f"{occurred} AS occurred_at",
                "CAST(NULL AS STRING) AS merchant_name",
                "CAST(NULL AS STRING) AS category",
                f"'{statement}' AS statement",
                "customer_id",
                "TRUE AS is_canonical",
                "FALSE AS is_transfer",
                "FALSE AS is_voided",
            ]

        revenue = invoices.selectExpr(*inflow(INVOICE, "revenue", "issued_on"))
        payments = invoices.where("paid_on IS NOT NULL").selectExpr(*inflow(PAYMENT, "asset", "paid_on"))
        return self._slim_expenses.unionByName(revenue).unionByName(payments)


def _ledger_rows(slim: DataFrame) -> DataFrame:
    """Ledger rows with all their columns; other columns of the slim rows stay behind them."""
    added = [c for c in slim.columns if c not in SLIM]
    return slim.selectExpr(
        "org_id",
        "'accounting' AS source",
        f"IF(kind IN ({BILL}, {PURCHASE}), concat_ws(':', key, line), CAST(key AS STRING)) AS source_txn_id",
        f"CASE kind WHEN {BILL} THEN 'Bill' WHEN {PURCHASE} THEN 'Purchase' WHEN {INVOICE} THEN 'Invoice' ELSE 'Payment' END AS source_record_type",
        f"IF(kind IN ({BILL}, {PURCHASE}), 'outflow', 'inflow') AS direction",
        "amount",
        "occurred_at",
        f"CASE WHEN kind IN ({PURCHASE}, {PAYMENT}) THEN occurred_at END AS posted_at",
        "merchant_name",
        "category",
        "statement",
        "customer_id",
        "is_canonical",
        "is_transfer",
        "is_voided",
        *added,
    )
