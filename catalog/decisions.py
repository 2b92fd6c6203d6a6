"""Alerts, reports, scoring, scenarios and the firm console."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.books import CONNECTIONS, connections
from catalog.forecast import INPUTS, OPTIONS, RISKS, inputs
from catalog.insights import ANOMALY, HEALTH_SQL, SERIES_SQL, d
from catalog.metrics import LAST30, PRIOR30, PRIOR_MONTH, TTM
from catalog.registry import query
from centavo.functions.money import minor
from centavo.functions.periods import Period, month_period
from centavo.operators import breakdowns, insights, metrics, quality
from centavo.operators.predicates import analytical
from centavo.plans import alerts, reports, scenarios
from centavo.plans import forecast as fc
from centavo.session import written
from centavo.sources.books import AS_OF

TAX_DUE = dt.date(2001, 9, 15)


def bills_due(b):
    """Unpaid bills, due thirty days after they were entered."""
    return (
        analytical(b.ledger)
        .where((F.col("source_record_type") == "Bill") & (F.col("occurred_at") > F.lit(dt.date(2001, 7, 2))) & (F.col("occurred_at") <= F.lit(AS_OF)))
        .select(
            "org_id",
            F.col("source_txn_id").alias("bill_id"),
            F.date_add("occurred_at", 30).alias("due_on"),
            minor("amount").alias("amount_minor"),
        )
    )


def cash(b):
    return (
        metrics.measures(b.ledger, [metrics.MetricRequest(TTM, ("cash_position",))])
        .select("org_id", F.col("r0_cash_minor").alias("cash_minor"))
    )


def overdue(b):
    late = F.when(F.col("status") == "overdue", minor("balance")).otherwise(0)
    return (
        b.invoices.where(F.col("status").isin("open", "partial", "overdue"))
        .groupBy("org_id", "customer_id")
        .agg(F.sum(late).alias("overdue_minor"))
    )


def tax(b):
    rates = b.organizations.select("org_id", F.lit("0.21").cast("decimal(4,2)").alias("rate"))
    return insights.tax_set_aside(b.ledger, Period(dt.date(2001, 1, 1), AS_OF), rates)


def rule_candidates(b):
    """The rules that read metrics; the forecast's risks are added by `all_candidates`."""
    return alerts.candidates(
        alerts.large_expense(bills_due(b), cash(b)),
        alerts.revenue_decline(metrics.metric_comparison(b.ledger, LAST30, PRIOR30, ("revenue",))),
        alerts.margin_compression(metrics.margin_change(b.ledger, PRIOR_MONTH, month_period(2001, 6))),
        alerts.expense_anomaly(insights.expense_anomalies(b.ledger, month_period(2001, 7))),
        alerts.overdue_key_customer(overdue(b)),
        alerts.concentration_breach(breakdowns.concentration(b.ledger, b.customers, TTM)),
        alerts.vendor_creep(insights.recurring_series(b.ledger, AS_OF)),
        alerts.tax_due(tax(b), TAX_DUE),
    )


def risk_candidates(b):
    return alerts.from_forecast(fc.forecast_risks(inputs(b, customers=True), OPTIONS))


def all_candidates(b):
    """All eleven rules: those of `rule_candidates`, and payroll, cash and runway of the forecast."""
    return alerts.candidates(rule_candidates(b), risk_candidates(b))


def _row(rule: str, severity: str, due: str, subject: str, material: str, rest: str) -> str:
    return f"""SELECT org_id, '{rule}' AS rule_key, '{severity}' AS severity, CAST({due} AS DATE) AS due_on, '{rule}:' || {subject} AS dedup_key, CAST({material} AS BIGINT) AS materiality_minor {rest}"""


RULES_SQL = (
    ANOMALY
    + SERIES_SQL
    + """, bl AS (SELECT org_id, source_txn_id AS id, occurred_at + 30 AS due, minor AS m FROM base WHERE source_record_type = 'Bill' AND occurred_at > DATE '2001-07-02' AND occurred_at <= DATE '2001-08-01'),
ch AS (SELECT org_id, SUM(flow) AS c FROM base WHERE posted_at <= DATE '2001-08-01' GROUP BY 1),
rv AS (SELECT org_id, COALESCE(SUM(CASE WHEN occurred_at >= DATE '2001-07-03' THEN minor END), 0) AS a, COALESCE(SUM(CASE WHEN occurred_at < DATE '2001-07-03' THEN minor END), 0) AS b FROM base WHERE statement = 'revenue' AND occurred_at BETWEEN DATE '2001-06-03' AND DATE '2001-08-01' GROUP BY 1),
mg AS (SELECT org_id, """
    + ", ".join(
        f"COALESCE(SUM(CASE WHEN statement = '{s}' AND occurred_at {op} DATE '2001-07-01' THEN minor END), 0) AS {n}"
        for s, op, n in (("revenue", ">=", "r1"), ("cogs", ">=", "c1"), ("revenue", "<", "r0"), ("cogs", "<", "c0"))
    )
    + f""" FROM base WHERE statement IN ('revenue', 'cogs') AND occurred_at BETWEEN DATE '2001-06-01' AND DATE '2001-07-31' GROUP BY 1),
dl AS (SELECT org_id, FLOOR((FLOOR({d('r1 - c1')} / {d('r1')} * {d(10000)} + {d(0.5)}) / {d(100)} - FLOOR({d('r0 - c0')} / {d('r0')} * {d(10000)} + {d(0.5)}) / {d(100)}) * {d(100)} + {d(0.5)}) / {d(100)} AS delta FROM mg WHERE r1 <> 0 AND r0 <> 0),
od AS (SELECT org_id, customer_id, SUM(CASE WHEN status = 'overdue' THEN balance_minor ELSE 0 END) AS o, SUM(SUM(CASE WHEN status = 'overdue' THEN balance_minor ELSE 0 END)) OVER (PARTITION BY org_id) AS t FROM docs WHERE status IN ('open', 'partial', 'overdue') GROUP BY 1, 2),
cc AS (SELECT b.org_id, c.name, SUM(minor) AS s FROM base b JOIN customers_c c ON c.customer_id = b.customer_id WHERE statement = 'revenue' AND occurred_at BETWEEN DATE '2000-08-01' AND DATE '2001-08-01' GROUP BY 1, 2),
ct AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY org_id ORDER BY s DESC, name) AS rn, SUM(s) OVER (PARTITION BY org_id) AS t FROM cc),
tx AS (SELECT org_id, SUM(CASE WHEN statement = 'revenue' THEN minor ELSE -minor END) AS p FROM base WHERE statement IN ('revenue', 'cogs', 'opex', 'payroll') AND occurred_at BETWEEN DATE '2001-01-01' AND DATE '2001-08-01' GROUP BY 1),
rules AS ("""
    + " UNION ALL ".join(
        (
            _row("large_expense_due", "high", "due", "id", "m", "FROM bl JOIN ch USING (org_id) WHERE m * 100 > GREATEST(c, 0) * 10"),
            _row("revenue_decline", "high", "NULL", "'trend'", "b - a", "FROM rv WHERE b > 0 AND (b - a) * 100 > b * 20"),
            _row("margin_compression", "medium", "NULL", "'month'", "0", "FROM dl WHERE delta <= -5"),
            _row("expense_anomaly", "medium", "NULL", "label", "excess_minor", "FROM anomalies"),
            _row("key_customer_overdue", "high", "NULL", "customer_id", "o", "FROM od WHERE o * 100 > t * 10"),
            _row("customer_concentration", "medium", "NULL", "name", "s", f"FROM ct WHERE rn = 1 AND {d('s')} / {d('t')} > 0.3"),
            _row("vendor_creep", "info", "NULL", "vendor", "typical_minor * 12", "FROM series WHERE trend_pct_per_year > 20"),
            _row("estimated_tax", "high", "DATE '2001-09-15'", "'2001-09-15'", "ROUND(CAST(p AS DECIMAL(19,0)) * 0.21)", "FROM tx WHERE ROUND(CAST(GREATEST(p, 0) AS DECIMAL(19,0)) * 0.21) > 0"),
        )
    )
    + ")\n"
)


@query("alert_candidates", "A-44", sql=RULES_SQL + "SELECT * FROM rules")
def alert_candidates(b):
    return rule_candidates(b)


@query(
    "forecast_alerts",
    "A-44",
    sql=RISKS
    + "SELECT org_id, kind AS rule_key, severity, date AS due_on, kind || ':' || date AS dedup_key, shortfall_minor AS materiality_minor FROM risks",
)
def forecast_alerts(b):
    return risk_candidates(b)


FIRED_SQL = (
    RISKS
    + RULES_SQL
    + """, fired AS MATERIALIZED (SELECT * FROM rules UNION ALL SELECT org_id, kind, severity, date, kind || ':' || date, shortfall_minor FROM risks),
week AS (SELECT *, 0 AS rank FROM fired WHERE severity = 'critical' UNION ALL
SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY org_id ORDER BY CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, materiality_minor DESC, dedup_key) AS INT) AS rank FROM fired WHERE severity <> 'critical') x WHERE rank <= 2)
"""
)


def fired(b):
    """What all eleven rules give today, evaluated once."""
    return written(all_candidates(b), "alerts")


@query("alerts_for_week", "O-9", sql=FIRED_SQL + "SELECT * FROM week")
def alerts_for_week(b):
    return alerts.select_for_week(fired(b))


@query("unseen_alerts", "O-10", sql=FIRED_SQL + "SELECT * FROM fired ANTI JOIN week USING (org_id, dedup_key)")
def unseen_alerts(b):
    """What the rules give beyond the alerts that an earlier run delivered and kept."""
    now = fired(b)
    delivered = written(alerts.select_for_week(now), "delivered")
    return alerts.unseen(now, delivered)


@query(
    "alert_lifecycle",
    "A-45",
    sql=""", today AS (SELECT DISTINCT org_id, 'late:' || customer_id AS k, MIN(due_date) OVER (PARTITION BY org_id, customer_id) AS due FROM docs WHERE status IN ('open', 'partial') AND due_date IS NOT NULL),
old AS (SELECT org_id, 'late:' || customer_id AS k, CASE WHEN MIN(total_minor) < 2000000 THEN 'dismissed' ELSE 'sent' END AS st FROM docs WHERE issued_on >= DATE '2001-06-01' GROUP BY org_id, customer_id)
SELECT COALESCE(t.org_id, o.org_id) AS org_id, COALESCE(t.k, o.k) AS dedup_key, CASE WHEN t.k IS NOT NULL THEN 'medium' END AS severity, t.due AS due_on, o.st AS previous_state,
CASE WHEN t.k IS NULL THEN CASE WHEN st = 'dismissed' THEN 'forgotten' ELSE 'resolved' END WHEN st = 'dismissed' THEN 'suppressed' WHEN st IS NULL THEN 'new' WHEN due - DATE '2001-08-01' IN (7, 2) THEN 'repeat' ELSE 'ongoing' END AS action
FROM today t FULL JOIN old o ON t.org_id = o.org_id AND t.k = o.k""",
)
def alert_lifecycle(b):
    """Invoices coming due as conditions, against alerts left from June's invoices."""
    key = F.concat(F.lit("late:"), F.col("customer_id").cast("string")).alias("dedup_key")
    today = (
        b.invoices.where(F.col("status").isin("open", "partial") & F.col("due_date").isNotNull())
        .groupBy("org_id", "customer_id")
        .agg(F.min("due_date").alias("due_on"))
        .select("org_id", key, F.lit("medium").alias("severity"), "due_on")
    )
    left = (
        b.invoices.where(F.col("issued_on") >= F.lit(dt.date(2001, 6, 1)))
        .groupBy("org_id", "customer_id")
        .agg(F.min(minor("total")).alias("m"))
        .select("org_id", key, F.when(F.col("m") < 2_000_000, "dismissed").otherwise("sent").alias("state"))
    )
    return alerts.lifecycle(today, left, AS_OF)


@query(
    "monthly_report",
    "A-46",
    "W-9",
    sql=""", orgs AS (SELECT n_nationkey AS org_id FROM nation),
p(name, lo, hi) AS (VALUES ('c', DATE '2001-07-01', DATE '2001-07-31'), ('m', DATE '2001-06-01', DATE '2001-06-30'), ('y', DATE '2000-07-01', DATE '2000-07-31')),
s AS (SELECT o.org_id, p.name, COALESCE(SUM(CASE WHEN statement = 'revenue' THEN minor END), 0) AS revenue, COALESCE(SUM(CASE WHEN statement = 'cogs' THEN minor END), 0) AS cogs, COALESCE(SUM(CASE WHEN statement IN ('opex', 'payroll') THEN minor END), 0) AS opex
  FROM orgs o CROSS JOIN p LEFT JOIN base b ON b.org_id = o.org_id AND b.occurred_at BETWEEN p.lo AND p.hi GROUP BY 1, 2),
l AS (SELECT org_id, name, 'revenue' AS metric_key, revenue AS v FROM s UNION ALL SELECT org_id, name, 'cogs', cogs FROM s UNION ALL SELECT org_id, name, 'operating_expenses', opex FROM s UNION ALL SELECT org_id, name, 'net_profit', revenue - cogs - opex FROM s),
w AS (SELECT org_id, metric_key, CAST(MAX(CASE WHEN name = 'c' THEN v END) AS BIGINT) AS current_minor, CAST(MAX(CASE WHEN name = 'm' THEN v END) AS BIGINT) AS prior_month_minor, CAST(MAX(CASE WHEN name = 'y' THEN v END) AS BIGINT) AS prior_year_minor FROM l GROUP BY 1, 2)
SELECT *, current_minor - prior_month_minor AS change_minor, current_minor - prior_year_minor AS year_change_minor FROM w""",
)
def monthly_report(b):
    return reports.monthly_report(b.ledger, b.organizations, PRIOR_MONTH)


@query(
    "weekly_brief_items",
    "A-46",
    sql=INPUTS
    + """SELECT org_id, pay_date AS date, 'payroll' AS kind, amount_minor FROM runs WHERE pay_date <= DATE '2001-08-15' AND amount_minor > 0
UNION ALL SELECT s.org_id, s.date, 'vendors', CAST(SUM(v.typical_minor) AS BIGINT) FROM spine s JOIN vendors v ON v.org_id = s.org_id AND v.day_of_month = day(s.date) WHERE s.i <= 14 GROUP BY 1, 2""",
)
def weekly_brief_items(b):
    return reports.coming_up(inputs(b), OPTIONS)


EARLIER = dt.date(2001, 5, 3)


def _shifted(sql: str) -> str:
    """The forecast SQL as of 3 May 2001."""
    for old, new in (
        ("2001-08-06", "2001-05-08"),
        ("2001-10-31", "2001-08-02"),
        ("2001-04-01", "2001-01-03"),
        ("2001-05-03", "2001-02-02"),
        ("2001-02-01", "2000-11-03"),
        ("2001-08-01", "2001-05-03"),
    ):
        sql = sql.replace(old, new)
    return sql


SCORES_SQL = (
    _shifted(INPUTS)
    + f""", h(h) AS (VALUES (7), (30), (90)), act AS (SELECT org_id, h, CAST(SUM(CASE WHEN posted_at <= DATE '2001-05-03' + h THEN flow ELSE 0 END) AS BIGINT) AS actual FROM base CROSS JOIN h WHERE posted_at <= DATE '2001-08-01' GROUP BY 1, 2),
scores AS (SELECT p.org_id, CAST(h AS INT) AS horizon_days, p.p50 AS predicted_minor, actual AS actual_minor, CASE WHEN actual <> 0 THEN FLOOR({d('ABS(p.p50 - actual)')} / {d('ABS(actual)')} * {d(1000000)} + {d(0.5)}) / {d(1000000)} END AS abs_pct_error,
actual BETWEEN p.p50 - p.spread AND p.p50 + p.up AS within_band FROM points p JOIN act a ON a.org_id = p.org_id AND a.h = p.i)
"""
)


def scores(b):
    options = fc.ForecastOptions(as_of=EARLIER)
    facts = fc.forecast_inputs(b.ledger, b.invoices, b.organizations, options)
    return reports.score_forecast(fc.forecast_points(facts, options), b.ledger, EARLIER)


@query("forecast_scores", "A-37", "J-17", sql=SCORES_SQL + "SELECT * FROM scores")
def forecast_scores(b):
    return scores(b)


@query(
    "forecast_accuracy",
    "A-37",
    sql=SCORES_SQL
    + f"""SELECT horizon_days, COUNT(*) AS n, FLOOR({d('SUM(CAST(ROUND(abs_pct_error * 1000000) AS BIGINT))')} / {d('COUNT(abs_pct_error)')} / {d(1000000)} * {d(1000000)} + {d(0.5)}) / {d(1000000)} AS mape,
FLOOR({d('COUNT(CASE WHEN within_band THEN 1 END)')} / {d('COUNT(*)')} * {d(10000)} + {d(0.5)}) / {d(10000)} AS band_rate FROM scores GROUP BY 1""",
)
def forecast_accuracy(b):
    return reports.accuracy(scores(b))


HIRE = scenarios.Scenario("hire", from_day=30, monthly_cost_minor=1_000_000, burdened=True)
SLOWER = scenarios.Scenario("slower payers, higher prices", collection_delay_days=10, revenue_factor="1.05")


@query(
    "scenario_hire",
    "2.10",
    sql=INPUTS
    + """, ex AS (SELECT org_id, i, p50, p50 - 1300000 * SUM(CASE WHEN i >= 30 AND day(date) = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY org_id ORDER BY i) AS q FROM points)
SELECT org_id, CAST(MAX(CASE WHEN i = 91 THEN p50 END) AS BIGINT) AS base_end_minor, CAST(MIN(p50) AS BIGINT) AS base_low_minor, CAST(MIN(CASE WHEN p50 < 0 THEN i END) AS INT) AS base_first_negative_day,
CAST(MAX(CASE WHEN i = 91 THEN q END) AS BIGINT) AS scenario_end_minor, CAST(MIN(q) AS BIGINT) AS scenario_low_minor, CAST(MIN(CASE WHEN q < 0 THEN i END) AS INT) AS scenario_first_negative_day,
CAST(MAX(CASE WHEN i = 91 THEN q - p50 END) AS BIGINT) AS difference_minor FROM ex GROUP BY 1""",
)
def scenario_hire(b):
    return scenarios.compare(inputs(b), OPTIONS, HIRE)


@query(
    "scenario_slower_collections",
    "2.10",
    sql=INPUTS
    + """, mv AS (SELECT org_id, CAST(pay_date - DATE '2001-08-01' AS INT) AS i, -amount_minor AS x FROM runs
UNION ALL SELECT s.org_id, s.i, -v.typical_minor FROM spine s JOIN vendors v ON v.org_id = s.org_id AND v.day_of_month = day(s.date)
UNION ALL SELECT org_id, CAST(expected_on - DATE '2001-08-01' AS INT) + 10, balance_minor FROM owed WHERE expected_on <= DATE '2001-10-31'
UNION ALL SELECT org_id, i, CAST(ROUND(CAST(monthly AS DECIMAL(18,0)) * 1.05) AS BIGINT) FROM spine WHERE day(date) = 1 AND i > lag + 10),
q AS (SELECT s.org_id, s.i, s.date, CAST(s.start - s.daily * s.i + SUM(COALESCE(m.x, 0)) OVER (PARTITION BY s.org_id ORDER BY s.i) AS BIGINT) AS p50 FROM spine s LEFT JOIN (SELECT org_id, i, SUM(x) AS x FROM mv GROUP BY 1, 2) m ON m.org_id = s.org_id AND m.i = s.i)
SELECT org_id, date, p50 FROM q""",
)
def scenario_slower_collections(b):
    return scenarios.scenario_points(inputs(b), OPTIONS, SLOWER).select("org_id", "date", "p50")


@query(
    "firm_console",
    "A-49",
    sql=FIRED_SQL
    + HEALTH_SQL.replace(", orgs AS (SELECT n_nationkey AS org_id FROM nation)", "")
    + """, gr AS (SELECT n_regionkey AS firm_id, n_nationkey AS org_id FROM nation),
conn AS """
    + CONNECTIONS.split("conn AS ", 1)[1].strip()
    + f""", fr AS (SELECT org_id, MAX(synced) AS last_sync_at, bool_or(status <> 'active') AS degraded FROM conn WHERE NOT gone GROUP BY 1),
al AS (SELECT org_id, COUNT(*) AS c FROM fired WHERE severity = 'critical' GROUP BY 1)
SELECT gr.firm_id, gr.org_id, health.score, CASE WHEN burn > 0 THEN FLOOR({d('cash')} / {d('burn')} * {d(10)} + {d(0.5)}) / {d(10)} END AS runway_months, COALESCE(al.c, 0) AS critical_alerts, last_sync_at, degraded
FROM gr LEFT JOIN health USING (org_id) LEFT JOIN everything e USING (org_id) LEFT JOIN al USING (org_id) LEFT JOIN fr USING (org_id)""",
)
def firm_console(b):
    """The clients of a firm with the critical alerts of all rules."""
    return _console(b, fired(b))


def _console(b, fired):
    grants = b.table("nation").select(
        F.col("n_regionkey").alias("firm_id"), F.col("n_nationkey").alias("org_id")
    )
    runway = metrics.metric_table(b.ledger, TTM, ["runway_months"], b.organizations).select(
        "org_id", F.col("value").alias("runway_months")
    )
    return alerts.firm_console(
        grants,
        insights.health_scores(b.ledger, b.customers, b.organizations, TTM),
        runway,
        fired,
        quality.data_freshness(connections(b)),
    )


@query(
    "nearest_chunks",
    "2.10",
    sql="""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, ROUND(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 20""",
    views=False,
)
def nearest_chunks(b):
    """The chunks nearest to the first one, whose vector stands for the question."""
    from centavo.operators.similarity import nearest_chunks

    chunks = b.table("embeddings")
    question = chunks.agg(F.min_by("embedding", "vec_id").alias("question"))
    return nearest_chunks(chunks, question, 20)
