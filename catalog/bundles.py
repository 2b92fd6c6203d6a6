"""Whole dashboards, pages of transactions per tenant, data quality, scenarios, price changes and partition purge."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.forecast import INPUTS, OPTIONS, inputs
from catalog.insights import BUSINESS, businesses
from catalog.matching import DUPLICATE_KEYS, SOURCES, rounds, two_sources
from catalog.metrics import CUSTOMER, TTM
from catalog.registry import ORACLE, query
from centavo.functions.money import minor
from centavo.operators import breakdowns, insights, matching, predicates, quality, search
from centavo.plans import dashboard, scenarios
from centavo.session import fresh_path
from centavo.sources.books import AS_OF
from centavo.sources.ledger import LedgerTable

# Part of the dashboard: the query that has the same rows, and the column that is summed.
PARTS = {
    "cards": ("dashboard_cards", "value_minor"),
    "series": ("monthly_series", "profit_minor"),
    "by_category": ("expenses_by_category", "total_minor"),
    "by_customer": ("revenue_by_customer", "total_minor"),
    "aging": ("receivables_aging", "balance_minor"),
    "concentration": ("revenue_concentration", "total_minor"),
    "drivers": ("expense_drivers", "delta_minor"),
    "forecast_points": ("cash_forecast", "p50"),
    "forecast_risks": ("forecast_risks", "shortfall_minor"),
    "forecast_assumptions": ("forecast_assumptions", "NULL"),
}


@query(
    "dashboard_bundle",
    "X-11",
    sql="\nUNION ALL\n".join(
        f"SELECT org_id, '{part}' AS part, COUNT(*) AS n, CAST(SUM({column}) AS BIGINT) AS total_minor FROM ({ORACLE[name]}) AS {part} GROUP BY org_id"
        for part, (name, column) in PARTS.items()
    ),
    views=False,
)
def dashboard_bundle(b):
    """Every part of every tenant's dashboard, as its rows and their sum."""
    return dashboard.bundle(dashboard.dashboard(b.ledger, b.invoices, b.customers, b.organizations, AS_OF))


@query(
    "tenant_pages",
    "O-8",
    sql=""", c AS (SELECT n_nationkey AS org_id, CASE WHEN n_nationkey % 3 > 0 THEN DATE '2001-06-15' END AS day FROM nation),
r AS (SELECT b.org_id, b.occurred_at, b.source_record_type, b.source_txn_id, b.minor AS amount_minor, ROW_NUMBER() OVER (PARTITION BY b.org_id ORDER BY b.occurred_at DESC, b.source_record_type, b.source_txn_id) AS place
FROM base b JOIN c USING (org_id) WHERE c.day IS NULL OR b.occurred_at < c.day OR (b.occurred_at = c.day AND (b.source_record_type > 'Invoice' OR (b.source_record_type = 'Invoice' AND b.source_txn_id > '5')))),
e AS (SELECT org_id, COUNT(*) > 20 AS has_more FROM r GROUP BY 1)
SELECT org_id, occurred_at, source_record_type, source_txn_id, amount_minor, CAST(place AS INT) AS place, has_more,
CASE WHEN has_more THEN MAX(CASE WHEN place = 20 THEN strftime(occurred_at, '%Y-%m-%d') || '|' || source_record_type || '|' || source_txn_id END) OVER (PARTITION BY org_id) END AS next_cursor
FROM r JOIN e USING (org_id) WHERE place <= 20""",
)
def tenant_pages(b):
    """A page of each tenant's transactions: of some tenants the first, of the others the one after a cursor."""
    rows = predicates.analytical(b.ledger).select("org_id", "occurred_at", "source_record_type", "source_txn_id", minor("amount").alias("amount_minor"))
    cursors = b.table("nation").select(F.col("n_nationkey").alias("org_id"), F.when(F.col("n_nationkey") % 3 > 0, F.lit("2001-06-15|Invoice|5")).alias("cursor"))
    return search.pages(rows, cursors, 20)


@query(
    "unreconciled_rows",
    "A-41",
    sql=SOURCES
    + rounds(DUPLICATE_KEYS, 3)
    + """, open AS (SELECT * FROM feed LEFT JOIN met ON r = row_id OR l = row_id)
SELECT org_id, source, COUNT(*) AS n, COUNT(CASE WHEN r IS NULL THEN 1 END) AS unreconciled_n,
FLOOR(CAST(COUNT(CASE WHEN r IS NULL THEN 1 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 10000 + 0.5) / 10000 AS unreconciled_share FROM open GROUP BY 1, 2""",
)
def unreconciled_rows(b):
    """Rows of the books and the bank without a counterpart of the same merchant in the other."""
    return quality.unreconciled(matching.cross_source_duplicates(two_sources(b), ("accounting", "bank"), edits=0))


QUARTERS = (0.25, 0.5, 0.75)


@query(
    "peer_benchmark_sketched",
    "A-38",
    sql=BUSINESS + "SELECT naics, revenue_band, COUNT(*) AS peers, TRUE AS within_bound FROM b GROUP BY 1, 2 HAVING COUNT(*) >= 30",
    views=False,
)
def peer_benchmark_sketched(b):
    """Quartiles from sketches that merge, each held against the exact ranks of its cell."""
    rows, cell = businesses(b), ["naics", "revenue_band"]
    told = insights.peer_sketch(rows, cell, "pct", QUARTERS)
    ranked = rows.join(told, cell).groupBy(*cell, "peers", "p").agg(
        *[F.count_if(F.col("pct") < F.col("p")[k]).alias(f"below{k}") for k in range(3)], *[F.count_if(F.col("pct") <= F.col("p")[k]).alias(f"upto{k}") for k in range(3)]
    )
    slack = F.ceil(F.col("peers") / insights.SKETCH_ACCURACY) + 1
    close = [(F.col(f"below{k}") <= F.col("peers") * q + slack) & (F.col(f"upto{k}") >= F.col("peers") * q - slack) for k, q in enumerate(QUARTERS)]
    return ranked.select(*cell, "peers", (close[0] & close[1] & close[2]).alias("within_bound"))


@query(
    "price_changes",
    "2.10",
    sql="""WITH m AS (SELECT CAST(s_nationkey AS INT) AS org_id, l_suppkey AS vendor_id, p_brand AS item, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
SUM(CAST(CAST(l_extendedprice AS DECIMAL(20,4)) * 100 AS BIGINT)) AS cost, SUM(CAST(l_quantity AS BIGINT)) AS units FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 1 GROUP BY 1, 2, 3, 4),
r AS (SELECT *, SUM(cost) OVER u AS cost0, SUM(units) OVER u AS units0, COUNT(*) OVER u AS months0, SUM(cost) OVER w AS cost_all, SUM(units) OVER w AS units_all, COUNT(*) OVER w AS months_all
FROM m WINDOW w AS (PARTITION BY org_id, vendor_id, item), u AS (PARTITION BY org_id, vendor_id, item ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, CAST(cost0 AS DOUBLE) / CAST(units0 AS DOUBLE) AS a, CAST(cost_all - cost0 AS DOUBLE) / CAST(units_all - units0 AS DOUBLE) AS z FROM r WHERE months0 >= 3 AND months_all - months0 >= 3),
s AS (SELECT *, (z - a) * (z - a) * (CAST(units0 AS DOUBLE) * CAST(units_all - units0 AS DOUBLE) / CAST(units_all AS DOUBLE)) AS gain FROM p),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY org_id, vendor_id, item ORDER BY gain DESC, month) AS rn FROM s)
SELECT org_id, vendor_id, item, month AS changed_in, FLOOR(a + 0.5) AS before_minor, FLOOR(z + 0.5) AS after_minor, CAST(FLOOR((z - a) * CAST(units_all - units0 AS DOUBLE) + 0.5) AS BIGINT) AS extra_minor FROM b WHERE rn = 1 AND z >= a * 1.1""",
    views=False,
)
def price_changes(b):
    """Vendors' items whose price per unit rose for good: month of the rise, both prices, what it has cost since."""
    parts = b.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    vendors = b.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("org_id"))
    bought = b.table("lineitem").where(F.col("l_quantity") >= 1).join(parts, "l_partkey").join(vendors, "l_suppkey")
    rows = bought.select(
        "org_id", F.col("l_suppkey").alias("vendor_id"), "item", F.to_date("l_shipdate").alias("day"), minor(F.col("l_extendedprice").cast("decimal(20,4)")).alias("cost_minor"), F.col("l_quantity").cast("bigint").alias("units")
    )
    return insights.price_changes(rows)


LOAN = scenarios.loan(5_000_000, "0.12", 24, from_day=10)
RAMP = scenarios.hire_with_ramp(1_000_000, 2_000_000, ramp_months=2, from_day=30)


def outcome_sql(deltas: str) -> str:
    """Base and scenario per tenant, from `x`: what the scenario adds on a day."""
    return (
        INPUTS
        + f""", top AS (SELECT org_id, total_minor AS best, SUM(total_minor) OVER (PARTITION BY org_id) AS every, ROW_NUMBER() OVER (PARTITION BY org_id ORDER BY total_minor DESC, label) AS rn FROM ({CUSTOMER}) t),
x AS ({deltas}),
ex AS (SELECT p.org_id, p.i, p.p50, p.p50 + SUM(COALESCE(x.d, 0)) OVER (PARTITION BY p.org_id ORDER BY p.i) AS q FROM points p LEFT JOIN (SELECT org_id, i, SUM(d) AS d FROM x GROUP BY 1, 2) x ON x.org_id = p.org_id AND x.i = p.i)
SELECT org_id, CAST(MAX(CASE WHEN i = 91 THEN p50 END) AS BIGINT) AS base_end_minor, CAST(MIN(p50) AS BIGINT) AS base_low_minor, CAST(MIN(CASE WHEN p50 < 0 THEN i END) AS INT) AS base_first_negative_day,
CAST(MAX(CASE WHEN i = 91 THEN q END) AS BIGINT) AS scenario_end_minor, CAST(MIN(q) AS BIGINT) AS scenario_low_minor, CAST(MIN(CASE WHEN q < 0 THEN i END) AS INT) AS scenario_first_negative_day,
CAST(MAX(CASE WHEN i = 91 THEN q - p50 END) AS BIGINT) AS difference_minor,
CAST(CASE WHEN MAX(CASE WHEN q < p50 THEN i END) < 91 THEN MAX(CASE WHEN q < p50 THEN i END) + 1 END AS INT) AS break_even_day FROM ex GROUP BY 1"""
    )


@query("scenario_loan", "2.10", sql=outcome_sql("SELECT org_id, i, CASE WHEN i = 10 THEN 5000000 ELSE 0 END - CASE WHEN i > 10 AND day(date) = 1 THEN 235367 ELSE 0 END AS d FROM spine"))
def scenario_loan(b):
    """50,000 at 12 % a year over 24 months: 2,353.67 on the first of each month."""
    return scenarios.compare_drivers(inputs(b), OPTIONS, LOAN)


@query(
    "scenario_hire_with_ramp",
    "2.10",
    sql=outcome_sql(
        "SELECT org_id, i, CASE WHEN day(date) = 1 AND i >= 30 THEN CASE WHEN date = DATE '2001-09-01' THEN 1000000 ELSE 2000000 END - 1300000 ELSE 0 END AS d FROM spine"
    ),
)
def scenario_hire_with_ramp(b):
    return scenarios.compare_drivers(inputs(b), OPTIONS, RAMP)


def shares(b):
    top = breakdowns.concentration(b.ledger, b.customers, TTM)
    return top.select("org_id", "share")


LOST = "SELECT s.org_id, s.i, {sign}CASE WHEN day(s.date) = 1 AND s.i > s.lag THEN CAST(FLOOR(CAST(s.monthly AS DOUBLE) * (CAST(best AS DOUBLE) / CAST(every AS DOUBLE)) + 0.5) AS BIGINT) ELSE 0 END AS d FROM spine s JOIN top ON top.org_id = s.org_id AND rn = 1"


@query("scenario_lose_customer", "2.10", sql=outcome_sql(LOST.format(sign="-")))
def scenario_lose_customer(b):
    """The largest customer buys no more; what it owes is still paid."""
    return scenarios.compare_drivers(inputs(b), OPTIONS, scenarios.customer_change(inputs(b), shares(b), OPTIONS, -1))


@query("scenario_win_customer", "2.10", sql=outcome_sql(LOST.format(sign="")))
def scenario_win_customer(b):
    """Another customer like the largest."""
    return scenarios.compare_drivers(inputs(b), OPTIONS, scenarios.customer_change(inputs(b), shares(b), OPTIONS, 1))


@query(
    "ledger_purge",
    "S-15",
    sql="""SELECT CAST(date_trunc('month', occurred_at) AS DATE) AS occurred_month, COUNT(*) AS n, date_trunc('month', occurred_at) < DATE '1994-08-01' AS dropped FROM ledger_c GROUP BY 1, 3""",
)
def ledger_purge(b):
    """The stored ledger as of August 2001 with seven years kept: rows of each month, and whether they were dropped."""
    table = LedgerTable(b.spark, fresh_path(b.spark, "purged"), b.ledger_table.schema, b.ledger_table.buckets)
    table.load(b.ledger_table.read())
    audit = table.purge_before(dt.date(1994, 8, 1), AS_OF)
    kept = table.read().groupBy("occurred_month").agg(F.count("*").alias("n"), F.lit(False).alias("dropped"))
    return kept.unionByName(audit.groupBy("occurred_month").agg(F.sum("n").alias("n"), F.lit(True).alias("dropped")))
