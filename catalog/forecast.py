"""Cash forecast: inputs, points, risks and assumptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from centavo.functions.money import minor
from centavo.functions.periods import after_days_before, after_months_before
from centavo.operators.behavior import fit_behavior
from centavo.operators.predicates import analytical, live
from centavo.plans import forecast as fc
from centavo.sources.books import AS_OF

OPTIONS = fc.ForecastOptions(as_of=AS_OF)

MEAN = "CAST(FLOOR(CAST({s} AS DECIMAL(38,4)) / {n} + 0.5) AS BIGINT)"


def mean(s: str, n: str) -> str:
    """Half-up integer mean in integers only."""
    return f"CAST(((2 * ({s}) + ({n})) - (((2 * ({s}) + ({n})) % (2 * ({n}))) + 2 * ({n})) % (2 * ({n}))) // (2 * ({n})) AS BIGINT)"


INPUTS = f"""
, live AS (SELECT *, CAST(amount * 100 AS BIGINT) AS minor FROM ledger_c WHERE is_canonical AND NOT is_voided),
orgs AS (SELECT n_nationkey AS org_id FROM nation),
cash AS (SELECT org_id, SUM(flow) AS start FROM base WHERE posted_at <= DATE '2001-08-01' GROUP BY 1),
span AS (SELECT org_id, CAST(MAX(occurred_at) - MIN(occurred_at) AS INT) AS history_days FROM live GROUP BY 1),
pays AS (SELECT org_id, occurred_at AS d, SUM(minor) AS m FROM live
  WHERE statement = 'payroll' AND occurred_at > DATE '2001-04-01' AND occurred_at <= DATE '2001-08-01' GROUP BY 1, 2),
gaps AS (SELECT org_id, d, m, d - LAG(d) OVER w AS gap, ROW_NUMBER() OVER (PARTITION BY org_id ORDER BY d DESC) AS back FROM pays WINDOW w AS (PARTITION BY org_id ORDER BY d)),
ranked AS (SELECT org_id, gap, ROW_NUMBER() OVER (PARTITION BY org_id ORDER BY gap) - 1 AS i, COUNT(*) OVER (PARTITION BY org_id) AS n FROM gaps WHERE gap IS NOT NULL),
cadence AS (SELECT org_id, CAST(gap AS INT) AS cadence_days FROM ranked WHERE i = n // 2 AND gap BETWEEN 5 AND 40),
typical AS (SELECT org_id, {mean('SUM(m)', 'COUNT(*)')} AS amount_minor, MAX(d) AS last_d FROM gaps WHERE back <= 6 GROUP BY 1),
runs AS (SELECT c.org_id, CAST(t.last_d + CAST(k.k * c.cadence_days AS INT) AS DATE) AS pay_date, t.amount_minor, c.cadence_days
  FROM cadence c JOIN typical t USING (org_id) CROSS JOIN (SELECT UNNEST(generate_series(1, 60)) AS k) k
  WHERE t.last_d + CAST(k.k * c.cadence_days AS INT) > DATE '2001-08-01' AND t.last_d + CAST(k.k * c.cadence_days AS INT) <= DATE '2001-10-31'),
vendors AS (SELECT org_id, merchant_name AS vendor, {mean('SUM(minor)', 'COUNT(*)')} AS typical_minor,
  {mean('SUM(day(occurred_at))', 'COUNT(*)')} AS day_of_month, COUNT(*) AS n FROM base
  WHERE merchant_name IS NOT NULL AND direction = 'outflow' AND statement IN ('opex', 'cogs')
  AND occurred_at > DATE '2001-04-01' AND occurred_at <= DATE '2001-08-01' GROUP BY 1, 2 HAVING COUNT(*) >= 3),
beh AS (SELECT org_id, customer_id, FLOOR(CAST(SUM(paid_on - due_date) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS mean_late, COUNT(*) AS n
  FROM docs WHERE status = 'paid' AND paid_on IS NOT NULL AND due_date IS NOT NULL GROUP BY 1, 2),
owed0 AS (SELECT d.org_id, d.customer_id, d.invoice_id, d.balance_minor, COALESCE(b.n >= 4, FALSE) AS confident,
  COALESCE(d.due_date, DATE '2001-08-01') + CAST(CASE WHEN b.n >= 4 THEN FLOOR(b.mean_late + 0.5) ELSE 14 END AS INT) AS e
  FROM docs d LEFT JOIN beh b ON b.org_id = d.org_id AND b.customer_id = d.customer_id
  WHERE d.status IN ('open', 'partial', 'overdue') AND d.balance > 0),
owed AS (SELECT *, CAST(CASE WHEN e <= DATE '2001-08-01' THEN DATE '2001-08-06' ELSE e END AS DATE) AS expected_on FROM owed0),
variable AS (SELECT org_id, {mean('SUM(minor)', '90')} AS daily FROM base WHERE direction = 'outflow' AND statement IN ('opex', 'cogs')
  AND merchant_name IS NULL AND occurred_at > DATE '2001-05-03' AND occurred_at <= DATE '2001-08-01' GROUP BY 1),
newrev AS (SELECT org_id, {mean('SUM(total_minor) * 2', '15')} AS monthly,
  CAST(CASE WHEN COUNT(paid_on - due_date) > 0 THEN {mean('SUM(paid_on - due_date)', 'GREATEST(COUNT(paid_on - due_date), 1)')} ELSE 14 END + 30 AS INT) AS lag
  FROM docs WHERE issued_on > DATE '2001-02-01' AND issued_on <= DATE '2001-08-01' GROUP BY 1),
one AS (SELECT o.org_id, COALESCE(start, 0) AS start, COALESCE(history_days, 0) AS history_days, COALESCE(daily, 0) AS daily,
  COALESCE(monthly, 0) AS monthly, COALESCE(lag, 44) AS lag FROM orgs o LEFT JOIN cash USING (org_id) LEFT JOIN span USING (org_id)
  LEFT JOIN variable USING (org_id) LEFT JOIN newrev USING (org_id)),
spine AS (SELECT one.*, s.i, CAST(DATE '2001-08-01' + CAST(s.i AS INT) AS DATE) AS date FROM one CROSS JOIN (SELECT UNNEST(generate_series(1, 91)) AS i) s),
moves AS (
  SELECT org_id, pay_date AS date, -amount_minor AS committed, 0 AS receivables FROM runs
  UNION ALL SELECT s.org_id, s.date, -SUM(v.typical_minor), 0 FROM spine s JOIN vendors v ON v.org_id = s.org_id AND v.day_of_month = day(s.date) GROUP BY 1, 2
  UNION ALL SELECT org_id, expected_on, 0, SUM(balance_minor) FROM owed GROUP BY 1, 2
  UNION ALL SELECT org_id, date, 0, monthly FROM spine WHERE day(date) = 1 AND i > lag),
daily AS (SELECT org_id, date, SUM(committed) AS committed, SUM(receivables) AS receivables FROM moves GROUP BY 1, 2),
cum AS (SELECT s.org_id, s.i, s.date, s.start, s.daily,
  SUM(COALESCE(d.committed, 0)) OVER w AS committed, SUM(COALESCE(d.receivables, 0)) OVER w AS receivables, -s.daily * s.i AS variable,
  FLOOR(SQRT(CAST(s.i AS DOUBLE)) * CAST(ABS(s.daily) AS DOUBLE) * CAST(2.6 AS DOUBLE) + CAST(s.i AS DOUBLE) * CAST(18000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS spread
  FROM spine s LEFT JOIN daily d ON d.org_id = s.org_id AND d.date = s.date WINDOW w AS (PARTITION BY s.org_id ORDER BY s.i)),
points AS (SELECT org_id, i, date, start, CAST(start + committed + receivables + variable AS BIGINT) AS p50, CAST(spread AS BIGINT) AS spread,
  CAST(FLOOR(spread * CAST(0.85 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS up, CAST(committed AS BIGINT) AS committed, CAST(receivables AS BIGINT) AS receivables, CAST(variable AS BIGINT) AS variable FROM cum)
"""


def inputs(b, customers: bool = False):
    return fc.forecast_inputs(b.ledger, b.invoices, b.organizations, OPTIONS, b.customers if customers else None)


@query("starting_cash", "X-1", sql=INPUTS + "SELECT org_id, CAST(start AS BIGINT) AS starting_cash_minor FROM one")
def starting_cash(b):
    return inputs(b).select("org_id", "starting_cash_minor")


@query(
    "recurring_vendors",
    "A-23",
    "F-3",
    sql=INPUTS + "SELECT * FROM vendors",
)
def recurring_vendors(b):
    return fc.recurring_vendors(fc.ledger_activity(b.ledger, OPTIONS), OPTIONS)


@query(
    "committed_vendors_by_day",
    "X-4",
    "J-10",
    sql=INPUTS
    + """SELECT s.org_id, s.date, CAST(SUM(v.typical_minor) AS BIGINT) AS vendor_minor FROM spine s
JOIN vendors v ON v.org_id = s.org_id AND v.day_of_month = day(s.date) GROUP BY 1, 2""",
)
def committed_vendors_by_day(b):
    return (
        fc.day_deltas(inputs(b), OPTIONS)
        .where(F.array_contains(F.transform("vendor_days", lambda e: e["dom"]), F.dayofmonth("date")))
        .select("org_id", "date", "vendor_minor")
    )


@query(
    "variable_spend_per_day",
    "A-24",
    sql=INPUTS + "SELECT org_id, CAST(daily AS BIGINT) AS daily_variable_minor FROM variable",
)
def variable_spend_per_day(b):
    cost = analytical(b.ledger).where(
        (F.col("direction") == "outflow")
        & F.col("statement").isin("opex", "cogs")
        & F.col("merchant_name").isNull()
        & after_days_before(F.col("occurred_at"), AS_OF, 90)
    )
    return cost.groupBy("org_id").agg(fc.half_up_mean(F.sum(minor("amount")), 90).alias("daily_variable_minor"))


@query(
    "new_revenue_run_rate",
    "A-25",
    sql=INPUTS + "SELECT org_id, monthly AS new_revenue_minor, lag AS collection_lag_days FROM newrev",
)
def new_revenue_run_rate(b):
    return fc.new_revenue(b.invoices, OPTIONS)


@query(
    "payroll_per_pay_date",
    "A-27",
    sql=INPUTS + "SELECT org_id, d AS pay_date, CAST(m AS BIGINT) AS payroll_minor FROM pays",
)
def payroll_per_pay_date(b):
    rows = live(b.ledger).where(
        (F.col("statement") == "payroll") & after_months_before(F.col("occurred_at"), AS_OF, 4)
    )
    return rows.groupBy("org_id", F.col("occurred_at").alias("pay_date")).agg(
        F.sum(minor("amount")).alias("payroll_minor")
    )


@query(
    "payroll_cadence",
    "W-2",
    "W-3",
    "W-4",
    sql=INPUTS
    + "SELECT c.org_id, c.cadence_days, t.amount_minor AS typical_payroll_minor FROM cadence c JOIN typical t USING (org_id)",
)
def payroll_cadence(b):
    return inputs(b).where(F.col("cadence_days").isNotNull()).select("org_id", "cadence_days", "typical_payroll_minor")


@query("projected_payroll", "X-2", sql=INPUTS + "SELECT * FROM runs")
def projected_payroll(b):
    return fc.projected_payroll(inputs(b), OPTIONS)


@query(
    "receivable_timing",
    "X-3",
    "J-4",
    sql=INPUTS
    + """SELECT org_id, expected_on, CAST(expected_on - DATE '2001-08-01' AS INT) AS day, CAST(SUM(balance_minor) AS BIGINT) AS balance_minor,
COUNT(*) AS n, bool_or(confident) AS confident FROM owed GROUP BY 1, 2, 3""",
)
def receivable_timing(b):
    return fc.receivable_timing(b.invoices, fit_behavior(b.invoices), OPTIONS)


@query(
    "new_revenue_by_day",
    "X-5",
    sql=INPUTS + "SELECT org_id, date, CAST(monthly AS BIGINT) AS new_revenue_minor FROM spine WHERE day(date) = 1 AND i > lag AND monthly > 0",
)
def new_revenue_by_day(b):
    lands = (F.dayofmonth("date") == 1) & (F.col("day") > F.col("collection_lag_days"))
    return (
        fc.day_deltas(inputs(b), OPTIONS)
        .where(lands & (F.col("new_revenue_minor") > 0))
        .select("org_id", "date", "new_revenue_minor")
    )


@query(
    "forecast_day_movements",
    "J-9",
    sql=INPUTS
    + """SELECT s.org_id, s.date, CAST(COALESCE(d.committed, 0) AS BIGINT) AS committed_delta, CAST(COALESCE(d.receivables, 0) AS BIGINT) AS receivables_delta,
CAST(-s.daily AS BIGINT) AS variable_delta FROM spine s LEFT JOIN daily d ON d.org_id = s.org_id AND d.date = s.date""",
)
def forecast_day_movements(b):
    return fc.day_deltas(inputs(b), OPTIONS).select(
        "org_id", "date", "committed_delta", "receivables_delta", "variable_delta"
    )


@query(
    "cash_forecast",
    "X-6",
    "W-1",
    sql=INPUTS
    + "SELECT org_id, date, p50 - spread AS p10, p50, p50 + up AS p90, committed, receivables, variable FROM points",
)
def cash_forecast(b):
    return fc.forecast_points(inputs(b), OPTIONS)


RISKS = (
    INPUTS
    + """, short AS (SELECT r.org_id, r.pay_date, p.i, r.amount_minor - p.p50 AS shortfall FROM runs r JOIN points p ON p.org_id = r.org_id AND p.date = r.pay_date WHERE p.p50 < r.amount_minor),
neg AS (SELECT org_id, MIN(i) AS i FROM points WHERE p50 < 0 GROUP BY 1),
late AS (SELECT s.org_id, s.pay_date, o.balance_minor, c.name, ROW_NUMBER() OVER (PARTITION BY s.org_id, s.pay_date ORDER BY o.balance_minor DESC, o.invoice_id) AS rn
  FROM short s JOIN owed o ON o.org_id = s.org_id AND o.expected_on > s.pay_date LEFT JOIN customers_c c ON c.customer_id = o.customer_id),
late3 AS (SELECT org_id, pay_date, COUNT(*) AS late_n, SUM(balance_minor) AS collectable, STRING_AGG(name, ', ' ORDER BY rn) AS names FROM late WHERE rn <= 3 GROUP BY 1, 2),
risks AS (
  SELECT org_id, 'payroll_shortfall' AS kind, CASE WHEN i <= 7 THEN 'critical' WHEN i <= 21 THEN 'high' ELSE 'medium' END AS severity, pay_date AS date,
    CAST(shortfall AS BIGINT) AS shortfall_minor, CAST(i AS INT) AS days_away FROM short
  UNION ALL SELECT p.org_id, 'cash_shortfall', CASE WHEN p.i <= 30 THEN 'critical' ELSE 'high' END, p.date, CAST(-p.p50 AS BIGINT), CAST(p.i AS INT)
    FROM points p JOIN neg n ON n.org_id = p.org_id AND n.i = p.i
  UNION ALL SELECT p.org_id, 'runway_threshold', 'medium', p.date, CAST(p.start - p.p50 AS BIGINT), 91 FROM points p
    WHERE p.i = 91 AND p.start > 0 AND p.p50 * 100 < p.start * 35 AND p.org_id NOT IN (SELECT org_id FROM neg))
"""
)


@query(
    "forecast_risks",
    "X-7",
    "X-8",
    "X-9",
    "W-6",
    "W-7",
    "J-11",
    "O-6",
    sql=RISKS + "SELECT org_id, kind, severity, date, shortfall_minor, days_away FROM risks",
)
def forecast_risks(b):
    risks = fc.forecast_risks(inputs(b, customers=True), OPTIONS)
    return risks.select("org_id", "kind", "severity", "date", "shortfall_minor", "days_away").orderBy(
        "org_id", "days_away", "kind"
    )


@query(
    "payroll_risk_actions",
    "X-7",
    "J-12",
    "O-5",
    "F-8",
    sql=RISKS
    + """SELECT s.org_id, s.pay_date AS date, CAST(COALESCE(l.late_n, 0) AS INT) AS late_n, CAST(COALESCE(l.collectable, 0) AS BIGINT) AS collect_minor,
COALESCE('Collect ' || l.late_n || ' open invoices: ' || l.names, '') AS collect_text, CAST(s.shortfall AS BIGINT) AS finance_minor,
'Payroll on ' || s.pay_date || ' is short by $' || printf('%,d', CAST(s.shortfall // 100 AS BIGINT)) || '.' || lpad(CAST(s.shortfall % 100 AS VARCHAR), 2, '0') AS headline
FROM short s LEFT JOIN late3 l USING (org_id, pay_date)""",
)
def payroll_risk_actions(b):
    risks = fc.forecast_risks(inputs(b, customers=True), OPTIONS).where(F.col("kind") == "payroll_shortfall")
    collect = F.get(F.filter("actions", lambda a: a["type"] == "collect"), 0)
    finance = F.get(F.filter("actions", lambda a: a["type"] == "finance"), 0)
    text = F.coalesce(collect["text"], F.lit(""))
    return risks.select(
        "org_id",
        "date",
        F.when(text == "", 0).otherwise(F.regexp_extract(text, r"Collect (\d+)", 1).try_cast("int")).alias("late_n"),
        F.coalesce(collect["impact_minor"], F.lit(0).cast("bigint")).alias("collect_minor"),
        text.alias("collect_text"),
        finance["impact_minor"].alias("finance_minor"),
        "headline",
    )


@query(
    "forecast_assumptions",
    "X-10",
    sql=INPUTS
    + """SELECT org_id, 'ar_timing_from_history' AS key, CASE WHEN k THEN 'per-customer history' ELSE '14 days late (prior)' END AS value,
CASE WHEN k THEN 'org_history' ELSE 'industry_prior' END AS source FROM (SELECT o.org_id, COALESCE(bool_or(confident), FALSE) AS k FROM orgs o LEFT JOIN owed USING (org_id) GROUP BY 1) x
UNION ALL SELECT org_id, 'payroll_cadence', CASE WHEN org_id IN (SELECT org_id FROM runs) THEN 'projected from history' ELSE 'none detected' END, 'org_history' FROM orgs
UNION ALL SELECT org_id, 'new_revenue', '$' || printf('%,d', CAST(monthly // 100 AS BIGINT)) || '.' || lpad(CAST(monthly % 100 AS VARCHAR), 2, '0') || '/mo', 'org_history' FROM one""",
)
def forecast_assumptions(b):
    return fc.forecast_assumptions(inputs(b))


@query(
    "forecast_summary",
    "X-6",
    "A-26",
    sql=INPUTS
    + """SELECT org_id, DATE '2001-08-01' AS as_of, 91 AS horizon_days, CAST(start AS BIGINT) AS starting_cash_minor, history_days,
CASE WHEN history_days < 90 THEN 'low' WHEN history_days < 365 THEN 'medium' ELSE 'high' END AS confidence, '1' AS method_version FROM one""",
)
def forecast_summary(b):
    return fc.forecast_summary(inputs(b), OPTIONS)
