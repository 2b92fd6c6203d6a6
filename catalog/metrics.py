"""Metric catalogue, breakdowns, aging, behaviour fit, drill-down."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.registry import query
from centavo.functions.money import minor, signed
from centavo.functions.periods import (
    Period,
    after_days_before,
    after_months_before,
    last_days,
    month_of,
    month_period,
    previous,
    trailing_months,
)
from centavo.operators import behavior, breakdowns, metrics
from centavo.operators.predicates import analytical, in_period, live, of_statement, open_documents, settled
from centavo.sources.books import AS_OF

TTM = trailing_months(AS_OF, 12)
MONTH = month_of(AS_OF)
PRIOR_MONTH = month_period(2001, 7)
LAST30 = last_days(AS_OF, 30)
PRIOR30 = previous(LAST30)

T = "occurred_at BETWEEN DATE '2000-08-01' AND DATE '2001-08-01'"

PNL = f"""
, orgs AS (SELECT n_nationkey AS org_id FROM nation),
pnl AS (
SELECT org_id,
       COALESCE(SUM(CASE WHEN {T} AND statement = 'revenue' THEN minor END), 0) AS rev,
       COUNT(CASE WHEN {T} AND statement = 'revenue' THEN 1 END) AS rev_n,
       COALESCE(SUM(CASE WHEN {T} AND statement = 'cogs' THEN minor END), 0) AS cogs,
       COUNT(CASE WHEN {T} AND statement = 'cogs' THEN 1 END) AS cogs_n,
       COALESCE(SUM(CASE WHEN {T} AND statement IN ('opex', 'payroll') THEN minor END), 0) AS opex,
       COUNT(CASE WHEN {T} AND statement IN ('opex', 'payroll') THEN 1 END) AS opex_n,
       COALESCE(SUM(CASE WHEN posted_at <= DATE '2001-08-01' THEN flow END), 0) AS cash,
       COUNT(CASE WHEN posted_at <= DATE '2001-08-01' THEN 1 END) AS cash_n
FROM orgs LEFT JOIN base USING (org_id) GROUP BY org_id
), nets AS (
SELECT org_id, date_trunc('month', posted_at) AS m, SUM(flow) AS net FROM base
WHERE posted_at > DATE '2001-02-01' AND posted_at <= DATE '2001-08-01' GROUP BY 1, 2
), burns AS (
SELECT org_id, COUNT(m) AS months, CASE WHEN COUNT(m) >= 2 THEN
         GREATEST(0, -FLOOR(CAST(SUM(net) AS DECIMAL(38,0)) / COUNT(m) + 0.5)) END AS burn
FROM orgs LEFT JOIN nets USING (org_id) GROUP BY org_id
), everything AS (SELECT * FROM pnl JOIN burns USING (org_id))"""

METRIC_COLUMNS = """org_id, DATE '2000-08-01' AS period_start, DATE '2001-08-01' AS period_end,
'trailing_12' AS grain, '1' AS engine_version"""


def _known(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 'insufficient_data' ELSE 'high' END"


BURN_CONF = "CASE WHEN months < 2 THEN 'insufficient_data' WHEN months < 4 THEN 'medium' ELSE 'high' END"

# metric key: unit, minor value, plain value, confidence, reason, source count, drill-down class
METRIC_SQL = {
    "revenue": (
        "currency",
        "rev",
        "NULL",
        _known("rev_n"),
        "CASE WHEN rev_n = 0 THEN 'no revenue in the period' END",
        "rev_n",
        "'revenue'",
    ),
    "cogs": ("currency", "cogs", "NULL", _known("cogs_n"), "NULL", "cogs_n", "'cogs'"),
    "gross_margin": (
        "percent",
        "NULL",
        "CASE WHEN rev <> 0 THEN FLOOR(CAST(rev - cogs AS DOUBLE) / CAST(rev AS DOUBLE) * 10000.0 + 0.5) / 100.0 END",
        "CASE WHEN rev = 0 THEN 'insufficient_data' WHEN rev_n > 0 THEN 'high' ELSE 'medium' END",
        "CASE WHEN rev = 0 THEN 'margin is undefined without revenue' END",
        "CASE WHEN rev = 0 THEN 0 ELSE rev_n + cogs_n END",
        "NULL",
    ),
    "operating_expenses": ("currency", "opex", "NULL", _known("opex_n"), "NULL", "opex_n", "NULL"),
    "net_profit": ("currency", "rev - cogs - opex", "NULL", _known("rev_n"), "NULL", "rev_n", "NULL"),
    "cash_position": ("currency", "cash", "NULL", _known("cash_n"), "NULL", "cash_n", "NULL"),
    "monthly_burn": (
        "currency",
        "burn",
        "NULL",
        BURN_CONF,
        """CASE WHEN months < 2 THEN 'fewer than two months of settled cash'
           WHEN months < 4 THEN 'only ' || months || ' months of history' END""",
        "months",
        "NULL",
    ),
    "runway_months": (
        "months",
        "NULL",
        "CASE WHEN burn > 0 THEN FLOOR(CAST(cash AS DOUBLE) / CAST(burn AS DOUBLE) * 10.0 + 0.5) / 10.0 END",
        f"CASE WHEN burn = 0 THEN 'high' ELSE {BURN_CONF} END",
        """CASE WHEN months < 2 THEN 'fewer than two months of settled cash'
           WHEN burn = 0 THEN 'cash positive over the window, no limit' END""",
        "0",
        "NULL",
    ),
}


def metric_select(key: str) -> str:
    unit, money, value, confidence, reason, count, drill = METRIC_SQL[key]
    return f"""SELECT {METRIC_COLUMNS}, '{key}' AS metric_key, '{unit}' AS unit, CAST({money} AS BIGINT) AS value_minor,
CAST({value} AS DOUBLE) AS value, {confidence} AS confidence, CAST({reason} AS VARCHAR) AS reason,
CAST({count} AS BIGINT) AS source_count, CAST({drill} AS VARCHAR) AS drill_statement FROM everything"""


def _register_metric(key: str, row: str) -> None:
    query(key, row, sql=f"{PNL}\n{metric_select(key)}")(
        lambda b: metrics.metric_table(b.ledger, TTM, [key], b.organizations)
    )


for _key, _row in (
    ("revenue", "A-2"),
    ("cogs", "A-3"),
    ("gross_margin", "A-4"),
    ("operating_expenses", "A-5"),
    ("net_profit", "A-6"),
    ("cash_position", "A-7"),
    ("monthly_burn", "A-8"),
    ("runway_months", "A-9"),
):
    _register_metric(_key, _row)


@query(
    "metric_table",
    "A-2",
    "A-3",
    "A-4",
    "A-5",
    "A-6",
    "A-7",
    "A-8",
    "A-9",
    "X-11",
    sql=PNL + "\n" + "\nUNION ALL\n".join(metric_select(k) for k in METRIC_SQL),
)
def metric_table(b):
    return metrics.metric_table(b.ledger, TTM, None, b.organizations)


@query(
    "statement_totals",
    "A-1",
    "P-1",
    "P-2",
    "P-4",
    sql=f"""SELECT org_id, statement, direction, CAST(SUM(minor) AS BIGINT) AS total_minor, COUNT(*) AS n
FROM base WHERE statement IN ('revenue', 'cogs', 'opex', 'payroll') AND {T} GROUP BY 1, 2, 3""",
)
def statement_totals(b):
    rows = of_statement(in_period(analytical(b.ledger), TTM), "revenue", "cogs", "opex", "payroll")
    return rows.groupBy("org_id", "statement", "direction").agg(
        F.sum(minor("amount")).alias("total_minor"), F.count("*").alias("n")
    )


@query(
    "outflow_totals_by_class",
    "A-1",
    "P-4",
    sql=f"""SELECT org_id,
CAST(COALESCE(SUM(CASE WHEN statement = 'opex' THEN minor END), 0) AS BIGINT) AS opex_minor, COUNT(CASE WHEN statement = 'opex' THEN 1 END) AS opex_n,
CAST(COALESCE(SUM(CASE WHEN statement = 'cogs' THEN minor END), 0) AS BIGINT) AS cogs_minor, COUNT(CASE WHEN statement = 'cogs' THEN 1 END) AS cogs_n
FROM base WHERE statement IN ('opex', 'cogs') AND direction = 'outflow' AND {T} GROUP BY 1""",
)
def outflow_totals_by_class(b):
    return metrics.statement_totals(b.ledger, TTM, ("opex", "cogs"), "outflow")


@query(
    "settled_cash_by_record_type",
    "P-5",
    sql="""SELECT org_id, source_record_type, CAST(SUM(flow) AS BIGINT) AS net_minor, COUNT(*) AS n
FROM base WHERE posted_at IS NOT NULL AND posted_at <= DATE '2001-08-01' GROUP BY 1, 2""",
)
def settled_cash_by_record_type(b):
    rows = analytical(b.ledger).where(settled(AS_OF))
    return rows.groupBy("org_id", "source_record_type").agg(
        F.sum(signed("direction", minor("amount"))).alias("net_minor"), F.count("*").alias("n")
    )


@query(
    "trailing_outflow",
    "P-3",
    "F-2",
    sql="""SELECT org_id,
CAST(COALESCE(SUM(CASE WHEN occurred_at > DATE '2001-02-01' THEN minor END), 0) AS BIGINT) AS six_months_minor,
CAST(COALESCE(SUM(CASE WHEN occurred_at > DATE '2001-05-03' THEN minor END), 0) AS BIGINT) AS ninety_days_minor
FROM base WHERE direction = 'outflow' AND occurred_at > DATE '2001-02-01' AND occurred_at <= DATE '2001-08-01' GROUP BY 1""",
)
def trailing_outflow(b):
    occurred = F.col("occurred_at")
    rows = analytical(b.ledger).where((F.col("direction") == "outflow") & after_months_before(occurred, AS_OF, 6))
    zero = F.lit(0).cast("bigint")
    return rows.groupBy("org_id").agg(
        F.sum(minor("amount")).alias("six_months_minor"),
        F.coalesce(F.sum(F.when(after_days_before(occurred, AS_OF, 90), minor("amount"))), zero).alias(
            "ninety_days_minor"
        ),
    )


SHARE = """, g AS ({grouped}), t AS (SELECT org_id, SUM(total_minor) AS tot, SUM(n) AS nn FROM g GROUP BY 1)
SELECT g.org_id, label, CAST(total_minor AS BIGINT) AS total_minor, n, CAST(nn AS BIGINT) AS org_source_count,
       CASE WHEN tot > 0 THEN CAST(total_minor AS DOUBLE) / CAST(tot AS DOUBLE) ELSE 0.0 END AS share
FROM g JOIN t USING (org_id)"""

CATEGORY = f"""SELECT org_id, label, SUM(minor) AS total_minor, COUNT(*) AS n FROM base
WHERE statement IN ('opex', 'cogs', 'payroll') AND {T} GROUP BY 1, 2"""

CUSTOMER = f"""SELECT b.org_id, COALESCE(c.name, 'Unattributed') AS label, SUM(minor) AS total_minor, COUNT(*) AS n
FROM base b LEFT JOIN customers_c c ON c.customer_id = b.customer_id AND c.org_id = b.org_id
WHERE statement = 'revenue' AND {T} GROUP BY 1, 2"""


@query("expenses_by_category", "A-10", "W-5", "J-1", sql=SHARE.format(grouped=CATEGORY))
def expenses_by_category(b):
    return breakdowns.expenses_by_category(b.ledger, TTM)


@query("revenue_by_customer", "A-11", "W-5", "J-2", sql=SHARE.format(grouped=CUSTOMER))
def revenue_by_customer(b):
    return breakdowns.revenue_by_customer(b.ledger, b.customers, TTM)


@query(
    "top_categories",
    "O-1",
    "O-4",
    "W-8",
    sql=f""", g AS ({CATEGORY}), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY org_id ORDER BY total_minor DESC, label) AS rank FROM g)
SELECT org_id, label, CAST(total_minor AS BIGINT) AS total_minor, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 9""",
)
def top_categories(b):
    rows = in_period(breakdowns.expense_rows(b.ledger), TTM)
    totals = rows.groupBy("org_id", breakdowns.category_label().alias("label")).agg(
        F.sum(minor("amount")).alias("total_minor"), F.count("*").alias("n")
    )
    return breakdowns.top_labels(totals, 9)


@query(
    "top_customers",
    "O-4",
    "W-8",
    sql=f""", g AS ({CUSTOMER}), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY org_id ORDER BY total_minor DESC, label) AS rank FROM g)
SELECT org_id, label, CAST(total_minor AS BIGINT) AS total_minor, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8""",
)
def top_customers(b):
    return breakdowns.top_labels(breakdowns.customer_totals(b.ledger, b.customers, TTM), 8)


@query(
    "revenue_concentration",
    "A-15",
    sql=f""", g AS ({CUSTOMER}), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY org_id ORDER BY total_minor DESC, label) AS rank,
   SUM(total_minor) OVER (PARTITION BY org_id) AS tot FROM g)
SELECT org_id, label AS customer, CAST(total_minor AS BIGINT) AS total_minor,
  CAST(total_minor AS DOUBLE) / CAST(tot AS DOUBLE) AS share, CAST(total_minor AS DOUBLE) / CAST(tot AS DOUBLE) > 0.3 AS concentrated
FROM r WHERE rank = 1""",
)
def revenue_concentration(b):
    return breakdowns.concentration(b.ledger, b.customers, TTM)


SERIES = """SELECT org_id, {bucket},
CAST(COALESCE(SUM(CASE WHEN statement = 'revenue' THEN minor END), 0) AS BIGINT) AS revenue_minor,
CAST(COALESCE(SUM(CASE WHEN statement = 'cogs' THEN minor END), 0) AS BIGINT) AS cogs_minor,
CAST(COALESCE(SUM(CASE WHEN statement IN ('opex', 'payroll') THEN minor END), 0) AS BIGINT) AS opex_minor
FROM base WHERE {where} GROUP BY 1, 2"""

SERIES_OUT = """SELECT *, revenue_minor - cogs_minor - opex_minor AS profit_minor,
CASE WHEN revenue_minor > 0 THEN FLOOR(CAST(revenue_minor - cogs_minor AS DOUBLE) / CAST(revenue_minor AS DOUBLE) * 10000.0 + 0.5) / 100.0 END AS gross_margin_pct
FROM s"""


@query(
    "monthly_series",
    "A-12",
    "F-1",
    "O-2",
    sql=", s AS ("
    + SERIES.format(
        bucket="strftime(occurred_at, '%Y-%m') AS month",
        where="occurred_at > DATE '1999-08-01' AND occurred_at <= DATE '2001-08-01'",
    )
    + ")\n"
    + SERIES_OUT,
)
def monthly_series(b):
    return metrics.monthly_series(b.ledger, AS_OF, 24)


for _grain in ("day", "week", "month", "quarter", "year"):
    query(
        f"series_by_{_grain}",
        "A-47",
        sql=", s AS ("
        + SERIES.format(bucket=f"CAST(date_trunc('{_grain}', occurred_at) AS DATE) AS bucket_start", where=T)
        + ")\n"
        + SERIES_OUT,
    )(lambda b, grain=_grain: metrics.metric_series(b.ledger, TTM, grain))


GRAINS_SQL = """, orgs AS (SELECT n_nationkey AS org_id FROM nation),
d AS (SELECT CAST(UNNEST(generate_series(DATE '2001-02-10', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS day),
g(grain) AS (VALUES ('day'), ('week'), ('month'), ('quarter'), ('year')),
k AS (SELECT grain, CAST(date_trunc(grain, day) AS DATE) AS bs, MIN(day) AS lo, MAX(day) AS be FROM d CROSS JOIN g GROUP BY 1, 2),
everything AS MATERIALIZED (SELECT o.org_id, k.grain, k.bs, k.be,
""" + ",\n".join(
    f"COALESCE(SUM(CASE WHEN occurred_at BETWEEN lo AND be AND statement IN ({s}) THEN minor END), 0) AS {n}, COUNT(CASE WHEN occurred_at BETWEEN lo AND be AND statement IN ({s}) THEN 1 END) AS {n}_n"
    for n, s in (("rev", "'revenue'"), ("cogs", "'cogs'"), ("opex", "'opex', 'payroll'"))
) + """,
COALESCE(SUM(CASE WHEN posted_at <= be THEN flow END), 0) AS cash, COUNT(CASE WHEN posted_at <= be THEN 1 END) AS cash_n,
COUNT(DISTINCT CASE WHEN posted_at > be - INTERVAL 6 MONTH AND posted_at <= be THEN date_trunc('month', posted_at) END) AS months,
CASE WHEN COUNT(DISTINCT CASE WHEN posted_at > be - INTERVAL 6 MONTH AND posted_at <= be THEN date_trunc('month', posted_at) END) >= 2 THEN
GREATEST(0, -FLOOR(CAST(SUM(CASE WHEN posted_at > be - INTERVAL 6 MONTH AND posted_at <= be THEN flow END) AS DECIMAL(38,0)) / COUNT(DISTINCT CASE WHEN posted_at > be - INTERVAL 6 MONTH AND posted_at <= be THEN date_trunc('month', posted_at) END) + 0.5)) END AS burn
FROM orgs o CROSS JOIN k LEFT JOIN base b ON b.org_id = o.org_id GROUP BY ALL)
"""


@query(
    "metric_grains",
    "A-47",
    sql=GRAINS_SQL
    + "\nUNION ALL\n".join(
        f"SELECT org_id, grain, bs AS bucket_start, be AS bucket_end, '{key}' AS metric_key, '{unit}' AS unit, CAST({money} AS BIGINT) AS value_minor, CAST({value} AS DOUBLE) AS value, "
        f"{confidence} AS confidence, {reason} AS reason, CAST({count} AS BIGINT) AS source_count, {drill} AS drill_statement FROM everything"
        for key, (unit, money, value, confidence, reason, count, drill) in METRIC_SQL.items()
    ),
)
def metric_grains(b):
    """All metrics by day, week, month, quarter and year over the last half year."""
    return metrics.metric_grains(b.ledger, Period(dt.date(2001, 2, 10), AS_OF), b.organizations)


AGING = """CASE WHEN due_date >= DATE '2001-08-01' THEN 'Current' WHEN due_date >= DATE '2001-07-02' THEN '1-30 days'
WHEN due_date >= DATE '2001-06-02' THEN '31-60 days' WHEN due_date >= DATE '2001-05-03' THEN '61-90 days' ELSE '90+ days' END"""


@query(
    "receivables_aging",
    "A-13",
    "P-6",
    "O-2",
    sql=f""", a AS (SELECT org_id, {AGING} AS bucket, balance_minor FROM docs WHERE status IN ('open', 'partial', 'overdue'))
SELECT org_id, bucket, CAST(SUM(balance_minor) AS BIGINT) AS balance_minor, COUNT(*) AS n,
CAST(CASE bucket WHEN 'Current' THEN 1 WHEN '1-30 days' THEN 2 WHEN '31-60 days' THEN 3 WHEN '61-90 days' THEN 4 ELSE 5 END AS INT) AS bucket_order
FROM a GROUP BY 1, 2""",
)
def receivables_aging(b):
    return breakdowns.receivables_aging(b.invoices, AS_OF)


@query(
    "invoice_states",
    "N-8",
    "P-6",
    sql="""SELECT org_id, status, COUNT(*) AS n, CAST(SUM(balance_minor) AS BIGINT) AS balance_minor,
COUNT(CASE WHEN balance > 0 AND status <> 'paid' THEN 1 END) AS owed_n FROM docs GROUP BY 1, 2""",
)
def invoice_states(b):
    owed = F.count(F.when((F.col("balance") > 0) & (F.col("status") != "paid"), 1))
    return b.invoices.groupBy("org_id", "status").agg(
        F.count("*").alias("n"), F.sum(minor("balance")).alias("balance_minor"), owed.alias("owed_n")
    )


CHANGE = """, g AS (
SELECT org_id, label,
CAST(COALESCE(SUM(CASE WHEN occurred_at BETWEEN DATE '2001-07-03' AND DATE '2001-08-01' THEN minor END), 0) AS BIGINT) AS current_minor,
CAST(COALESCE(SUM(CASE WHEN occurred_at BETWEEN DATE '2001-06-03' AND DATE '2001-07-02' THEN minor END), 0) AS BIGINT) AS prior_minor
FROM base WHERE statement IN ('opex', 'cogs', 'payroll') AND occurred_at BETWEEN DATE '2001-06-03' AND DATE '2001-08-01' GROUP BY 1, 2
), d AS (SELECT *, current_minor - prior_minor AS delta_minor, SUM(ABS(current_minor - prior_minor)) OVER (PARTITION BY org_id) AS tot FROM g),
c AS (SELECT org_id, label, current_minor, prior_minor, delta_minor,
CASE WHEN tot > 0 THEN CAST(ABS(delta_minor) AS DOUBLE) / CAST(tot AS DOUBLE) ELSE 0.0 END AS share_of_change FROM d)
"""


@query("expense_change", "A-14", "J-3", sql=CHANGE + "SELECT * FROM c")
def expense_change(b):
    return breakdowns.expense_change(b.ledger, LAST30, PRIOR30)


@query(
    "expense_drivers",
    "A-14",
    "O-2",
    "O-4",
    sql=CHANGE
    + """SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY org_id ORDER BY ABS(delta_minor) DESC, label) AS INT) AS rank FROM c) x
WHERE rank <= 6""",
)
def expense_drivers(b):
    return breakdowns.top_drivers(breakdowns.expense_change(b.ledger, LAST30, PRIOR30))


@query(
    "margin_change",
    "W-9",
    "A-4",
    "F-5",
    sql=""", g AS (
SELECT org_id,
COALESCE(SUM(CASE WHEN statement = 'revenue' AND occurred_at >= DATE '2001-07-01' THEN minor END), 0) AS r1,
COALESCE(SUM(CASE WHEN statement = 'cogs' AND occurred_at >= DATE '2001-07-01' THEN minor END), 0) AS c1,
COALESCE(SUM(CASE WHEN statement = 'revenue' AND occurred_at < DATE '2001-07-01' THEN minor END), 0) AS r0,
COALESCE(SUM(CASE WHEN statement = 'cogs' AND occurred_at < DATE '2001-07-01' THEN minor END), 0) AS c0
FROM base WHERE statement IN ('revenue', 'cogs') AND occurred_at BETWEEN DATE '2001-06-01' AND DATE '2001-07-31' GROUP BY 1
), m AS (SELECT org_id, CASE WHEN r1 <> 0 THEN FLOOR(CAST(r1 - c1 AS DOUBLE) / CAST(r1 AS DOUBLE) * 10000.0 + 0.5) / 100.0 END AS margin_pct,
CASE WHEN r0 <> 0 THEN FLOOR(CAST(r0 - c0 AS DOUBLE) / CAST(r0 AS DOUBLE) * 10000.0 + 0.5) / 100.0 END AS prior_margin_pct FROM g),
d AS (SELECT *, FLOOR((margin_pct - prior_margin_pct) * 100.0 + 0.5) / 100.0 AS delta_points FROM m)
SELECT *, CASE WHEN delta_points > 0 THEN 'up' WHEN delta_points < 0 THEN 'down' WHEN delta_points = 0 THEN 'flat' END AS direction FROM d""",
)
def margin_change(b):
    return metrics.margin_change(b.ledger, PRIOR_MONTH, month_period(2001, 6))


FITTED = """, lags AS (
SELECT org_id, customer_id, CAST(paid_on - due_date AS BIGINT) AS d FROM docs
WHERE status = 'paid' AND paid_on IS NOT NULL AND due_date IS NOT NULL AND customer_id IS NOT NULL
)"""


@query(
    "payment_behavior",
    "A-16",
    sql=FITTED
    + """
SELECT org_id, customer_id, FLOOR(CAST(SUM(d) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS mean_days_late,
FLOOR(SQRT(CAST(COUNT(*) * SUM(d * d) - SUM(d) * SUM(d) AS DOUBLE)) / CAST(COUNT(*) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS stddev,
ROUND(quantile_cont(CAST(d AS DOUBLE), 0.5), 4) AS p50, ROUND(quantile_cont(CAST(d AS DOUBLE), 0.9), 4) AS p90, COUNT(*) AS sample_count
FROM lags GROUP BY 1, 2""",
)
def payment_behavior(b):
    return behavior.fit_behavior(b.invoices)


@query(
    "payment_behavior_by_rank",
    "A-17",
    sql=FITTED
    + """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY org_id, customer_id ORDER BY d) - 1 AS i, COUNT(*) OVER (PARTITION BY org_id, customer_id) AS n FROM lags)
SELECT org_id, customer_id,
FLOOR(CAST(SUM(d) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 1000000.0 + 0.5) / 1000000.0 AS mean_days_late,
FLOOR(SQRT(CAST(COUNT(*) * SUM(d * d) - SUM(d) * SUM(d) AS DOUBLE)) / CAST(COUNT(*) AS DOUBLE) * 1000000.0 + 0.5) / 1000000.0 AS stddev,
CAST(MAX(CASE WHEN i = FLOOR(n * 0.5) THEN d END) AS BIGINT) AS p50, CAST(MAX(CASE WHEN i = FLOOR(n * 0.9) THEN d END) AS BIGINT) AS p90,
COUNT(*) AS sample_count FROM r GROUP BY 1, 2 HAVING COUNT(*) >= 4""",
)
def payment_behavior_by_rank(b):
    return behavior.fit_behavior_by_rank(b.invoices)


@query(
    "customers_with_behavior",
    "J-6",
    sql=FITTED
    + """, f AS (SELECT org_id, customer_id, FLOOR(CAST(SUM(d) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS mean_days_late,
COUNT(*) AS sample_count FROM lags GROUP BY 1, 2)
SELECT c.org_id, c.customer_id, c.name, f.mean_days_late, f.sample_count FROM customers_c c LEFT JOIN f USING (org_id, customer_id)""",
)
def customers_with_behavior(b):
    joined = behavior.with_behavior(b.customers, behavior.fit_behavior(b.invoices))
    return joined.select(
        "org_id",
        "customer_id",
        "name",
        F.col("payment_behavior.mean_days_late").alias("mean_days_late"),
        F.col("payment_behavior.sample_count").alias("sample_count"),
    )


DRILL = """SELECT org_id, occurred_at AS date, merchant_name, minor AS amount_minor, direction, label AS category, source_record_type, source_txn_id,
CAST(ROW_NUMBER() OVER (PARTITION BY org_id ORDER BY minor DESC, source_record_type, source_txn_id) AS INT) AS rank FROM base {where}"""


@query("drill_down", "O-3", "P-10", sql=f"SELECT * FROM ({DRILL.format(where=f'WHERE {T}')}) x WHERE rank <= 100")
def drill_down(b):
    return breakdowns.drill_down(b.ledger, TTM.start, TTM.end)


@query(
    "drill_down_opex_all_dates",
    "O-3",
    "P-10",
    sql="""SELECT * FROM ({}) x WHERE rank <= 100""".format(DRILL.format(where="WHERE statement = 'opex'")),
)
def drill_down_opex_all_dates(b):
    return breakdowns.drill_down(b.ledger, statement="opex")


@query(
    "history_span",
    "A-26",
    "F-11",
    sql=""", s AS (SELECT org_id, CAST(MAX(occurred_at) - MIN(occurred_at) AS INT) AS history_days FROM ledger_c
WHERE is_canonical AND NOT is_voided GROUP BY 1)
SELECT *, CASE WHEN history_days < 90 THEN 'low' WHEN history_days < 365 THEN 'medium' ELSE 'high' END AS confidence FROM s""",
)
def history_span(b):
    from centavo.plans.forecast import history_confidence

    return (
        live(b.ledger)
        .groupBy("org_id")
        .agg(F.datediff(F.max("occurred_at"), F.min("occurred_at")).alias("history_days"))
        .withColumn("confidence", history_confidence(F.col("history_days")))
    )


MARGIN_SQL = """SELECT org_id, DATE '{start}' AS period_start, DATE '{end}' AS period_end, 'month' AS grain, '1' AS engine_version, 'gross_margin' AS metric_key, 'percent' AS unit,
CAST(NULL AS BIGINT) AS value_minor, CASE WHEN r <> 0 THEN FLOOR(CAST(r - c AS DOUBLE) / CAST(r AS DOUBLE) * 10000.0 + 0.5) / 100.0 END AS value,
CASE WHEN r = 0 THEN 'insufficient_data' ELSE 'high' END AS confidence, CASE WHEN r = 0 THEN 'margin is undefined without revenue' END AS reason,
CASE WHEN r = 0 THEN 0 ELSE n END AS source_count, CAST(NULL AS VARCHAR) AS drill_statement
FROM (SELECT org_id, COALESCE(SUM(CASE WHEN statement = 'revenue' THEN minor END), 0) AS r, COALESCE(SUM(CASE WHEN statement = 'cogs' THEN minor END), 0) AS c,
COUNT(statement) AS n FROM orgs LEFT JOIN (SELECT * FROM base WHERE statement IN ('revenue', 'cogs') AND occurred_at BETWEEN DATE '{start}' AND DATE '{end}') x USING (org_id) GROUP BY 1) y"""


@query(
    "dashboard_cards",
    "X-11",
    "F-5",
    sql=PNL
    + "\n"
    + "\nUNION ALL\n".join(
        metric_select(k)
        for k in ("cash_position", "runway_months", "revenue", "net_profit", "operating_expenses", "monthly_burn")
    )
    + "\nUNION ALL\n"
    + MARGIN_SQL.format(start="2001-08-01", end="2001-08-31")
    + "\nUNION ALL\n"
    + MARGIN_SQL.format(start="2001-07-01", end="2001-07-31"),
)
def dashboard_cards(b):
    from centavo.plans.dashboard import cards

    return cards(b.ledger, b.organizations, AS_OF)
