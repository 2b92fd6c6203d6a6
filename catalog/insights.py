"""Second-tier analyses with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.books import connections
from catalog.metrics import PNL, T, TTM
from catalog.registry import query
from centavo.functions.money import minor
from centavo.functions.periods import Period, month_period
from centavo.operators import insights, product
from centavo.operators.predicates import live, live_connections
from centavo.operators.quality import quality_rate
from centavo.sources.books import AS_OF

D = "CAST({} AS DOUBLE)"


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def fmean(s: str, n: str) -> str:
    return f"CAST(FLOOR((CAST({s} AS DECIMAL(38,0)) * 2 + {n}) // ({n} * 2)) AS BIGINT)"


SERIES_SQL = f"""
, days AS (SELECT org_id, merchant_name AS vendor, occurred_at AS day, SUM(minor) AS y FROM base WHERE merchant_name IS NOT NULL AND direction = 'outflow' AND statement IN ('opex', 'cogs')
  AND occurred_at > DATE '2000-08-01' AND occurred_at <= DATE '2001-08-01' GROUP BY 1, 2, 3),
g AS (SELECT *, day - LAG(day) OVER (PARTITION BY org_id, vendor ORDER BY day) AS gap, day - DATE '2001-08-01' AS x FROM days),
s AS (SELECT org_id, vendor, COUNT(*) AS n, MAX(day) AS last_day, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS gap, SUM(y) AS sy, SUM(CAST(y AS HUGEINT) * y) AS syy, SUM(x) AS sx, SUM(x * x) AS sxx, SUM(x * y) AS sxy FROM g GROUP BY 1, 2 HAVING COUNT(*) >= 3),
series AS (SELECT org_id, vendor, CASE WHEN gap <= 9 THEN 'weekly' WHEN gap <= 14 THEN 'biweekly' WHEN gap <= 20 THEN 'semimonthly' WHEN gap <= 45 THEN 'monthly' WHEN gap <= 135 THEN 'quarterly' ELSE 'annual' END AS cadence,
  CAST((2 * sy + n) // (2 * n) AS BIGINT) AS typical_minor,
  CAST(FLOOR(SQRT(GREATEST({d('n')} * {d('syy')} - {d('sy')} * {d('sy')}, {d(0)})) / {d('n')} + {d(0.5)}) AS BIGINT) AS stddev_minor,
  CAST(last_day + CAST(FLOOR(gap + 0.5) AS INT) AS DATE) AS next_expected_on,
  FLOOR((({d('n')} * {d('sxy')} - {d('sx')} * {d('sy')}) / ({d('n')} * {d('sxx')} - {d('sx')} * {d('sx')})) * {d(365)} / ({d('sy')} / {d('n')}) * {d(100)} * {d(100)} + {d(0.5)}) / {d(100)} AS trend_pct_per_year, n
  FROM s WHERE gap <= 400)
"""


@query("recurring_series", "A-33", sql=SERIES_SQL + "SELECT * FROM series")
def recurring_series(b):
    return insights.recurring_series(b.ledger, AS_OF)


@query(
    "working_capital",
    "A-34",
    sql=f""", o AS (SELECT org_id, SUM(balance_minor) AS open_minor FROM docs WHERE status IN ('open', 'partial', 'overdue') GROUP BY 1),
l AS (SELECT org_id, SUM(CASE WHEN statement = 'revenue' AND occurred_at > DATE '2001-05-03' AND occurred_at <= DATE '2001-08-01' THEN minor ELSE 0 END) AS revenue_minor,
SUM(CASE WHEN source_record_type = 'Bill' AND occurred_at <= DATE '2001-08-01' THEN minor ELSE 0 END) AS payable_minor, COUNT(CASE WHEN source_record_type = 'Bill' AND occurred_at <= DATE '2001-08-01' THEN 1 END) AS payable_n FROM base GROUP BY 1)
SELECT n_nationkey AS org_id, CAST(COALESCE(open_minor, 0) AS BIGINT) AS open_minor, CAST(COALESCE(revenue_minor, 0) AS BIGINT) AS revenue_minor, CAST(COALESCE(payable_minor, 0) AS BIGINT) AS payable_minor, COALESCE(payable_n, 0) AS payable_n,
CASE WHEN COALESCE(revenue_minor, 0) > 0 THEN FLOOR({d('COALESCE(open_minor, 0)')} / {d('revenue_minor')} * {d(90)} * {d(10)} + {d(0.5)}) / {d(10)} END AS dso_days
FROM nation LEFT JOIN o ON o.org_id = n_nationkey LEFT JOIN l ON l.org_id = n_nationkey""",
)
def working_capital(b):
    return insights.working_capital(b.ledger, b.invoices, b.organizations, AS_OF)


@query(
    "customer_profitability",
    "A-35",
    sql=""", c AS (SELECT split_part(source_txn_id, ':', 1) AS ref, SUM(minor) AS cost FROM base WHERE statement = 'cogs' AND direction = 'outflow' GROUP BY 1)
SELECT org_id, customer_id, CAST(SUM(total_minor) AS BIGINT) AS revenue_minor, CAST(CASE WHEN COUNT(cost) > 0 THEN SUM(total_minor) - SUM(cost) END AS BIGINT) AS profit_minor,
CASE WHEN COUNT(cost) > 0 THEN 'high' ELSE 'insufficient_data' END AS confidence FROM docs LEFT JOIN c ON c.ref = CAST(invoice_id AS VARCHAR) GROUP BY 1, 2""",
)
def customer_profitability(b):
    return insights.customer_profitability(b.invoices, insights.project_costs(b.ledger))


@query(
    "daily_balances",
    "A-36",
    sql=""", m AS (SELECT org_id, source_record_type AS account, posted_at AS day, SUM(flow) AS net FROM base WHERE posted_at <= DATE '2001-08-01' GROUP BY 1, 2, 3),
f AS (SELECT org_id, account, MIN(day) AS lo FROM m GROUP BY 1, 2),
sp AS (SELECT org_id, account, CAST(UNNEST(generate_series(lo, DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS day FROM f)
SELECT sp.org_id, sp.account, sp.day, CAST(SUM(COALESCE(net, 0)) OVER (PARTITION BY sp.org_id, sp.account ORDER BY sp.day) AS BIGINT) AS balance_minor FROM sp LEFT JOIN m ON m.org_id = sp.org_id AND m.account = sp.account AND m.day = sp.day""",
)
def daily_balances(b):
    return insights.daily_balances(b.ledger, AS_OF)


BUSINESS = """WITH t AS (SELECT o_custkey, COUNT(*) AS n, COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS m FROM orders GROUP BY 1),
b AS (SELECT c_mktsegment AS naics, CASE WHEN m < 100000000 THEN 'small' WHEN m < 400000000 THEN 'medium' ELSE 'large' END AS revenue_band, CAST(FLOOR(100 * f / n) AS INT) AS pct FROM t JOIN customer ON c_custkey = o_custkey)
"""


@query(
    "peer_benchmark",
    "A-38",
    sql=BUSINESS
    + "SELECT naics, revenue_band, COUNT(*) AS peers, ROUND(quantile_cont(CAST(pct AS DOUBLE), 0.25), 4) AS p25, ROUND(quantile_cont(CAST(pct AS DOUBLE), 0.5), 4) AS p50, ROUND(quantile_cont(CAST(pct AS DOUBLE), 0.75), 4) AS p75 FROM b GROUP BY 1, 2 HAVING COUNT(*) >= 30",
    views=False,
)
def peer_benchmark(b):
    """Each customer as a business: share of its orders finished, by segment and size."""
    return insights.peer_benchmark(businesses(b), ["naics", "revenue_band"], "pct")


def businesses(b):
    totals = b.table("orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"),
        F.sum(minor(F.col("o_totalprice").cast("decimal(20,4)"))).alias("m"),
    )
    band = F.when(F.col("m") < 100_000_000, "small").when(F.col("m") < 400_000_000, "medium").otherwise("large")
    return totals.join(b.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("naics"),
        band.alias("revenue_band"),
        F.floor(F.col("f") * 100 / F.col("n")).cast("int").alias("pct"),
    )


def _score(x: str) -> str:
    return f"CAST(GREATEST(0, LEAST(100, FLOOR({x} + {d(0.5)}))) AS INT)"


HEALTH_SQL = f"""{PNL}
, op AS (SELECT org_id, SUM(CASE WHEN occurred_at BETWEEN DATE '1999-08-01' AND DATE '2000-08-01' AND statement = 'revenue' THEN minor END) AS prior FROM base GROUP BY 1),
top AS (SELECT org_id, MAX({d('s')} / {d('t')}) AS top_share FROM (SELECT org_id, customer_id, SUM(minor) AS s, SUM(SUM(minor)) OVER (PARTITION BY org_id) AS t FROM base WHERE statement = 'revenue' AND {T} GROUP BY 1, 2) x GROUP BY 1),
hyg AS (SELECT org_id, {d("COUNT(CASE WHEN category IS NULL THEN 1 END)")} / {d('COUNT(*)')} AS unc FROM base WHERE statement IN ('opex', 'cogs', 'payroll') GROUP BY 1),
mean AS (SELECT org_id, CASE WHEN COUNT(m) > 0 THEN FLOOR(CAST(SUM(net) AS DECIMAL(38,0)) / COUNT(m) + 0.5) END AS mean_net FROM orgs LEFT JOIN nets USING (org_id) GROUP BY 1),
h AS (SELECT e.org_id,
  CASE WHEN months < 2 THEN 0 WHEN mean_net < 0 THEN {_score(f"{d('cash')} / {d('-mean_net')} / {d(12)} * {d(100)}")} ELSE 100 END AS liquidity,
  CASE WHEN rev > 0 THEN {_score(f"{d(50)} + ({d('rev')} - {d('cogs')} - {d('opex')}) / {d('rev')} * {d(200)}")} ELSE 0 END AS profitability,
  CASE WHEN prior > 0 THEN {_score(f"{d(50)} + ({d('rev')} - {d('prior')}) / {d('prior')} * {d(100)}")} ELSE 50 END AS growth,
  CASE WHEN rev > 0 THEN {_score(f"{d(100)} - {d('opex')} / {d('rev')} * {d(100)}")} ELSE 0 END AS efficiency,
  {_score(f"{d(100)} - COALESCE(top_share, 1) * {d(100)}")} AS concentration, {_score(f"{d(100)} - COALESCE(unc, 0) * {d(100)}")} AS hygiene
  FROM everything e LEFT JOIN op USING (org_id) LEFT JOIN top USING (org_id) LEFT JOIN hyg USING (org_id) LEFT JOIN mean USING (org_id)),
health AS (SELECT *, CAST((liquidity * 25 + profitability * 20 + growth * 15 + efficiency * 15 + concentration * 15 + hygiene * 10 + 50) // 100 AS INT) AS score FROM h),
lev AS (SELECT org_id, part FROM (SELECT org_id, part, ROW_NUMBER() OVER (PARTITION BY org_id ORDER BY lost DESC, part) AS rn FROM (
  SELECT org_id, UNNEST(['liquidity', 'profitability', 'growth', 'efficiency', 'concentration', 'hygiene']) AS part,
  UNNEST([(100 - liquidity) * 25, (100 - profitability) * 20, (100 - growth) * 15, (100 - efficiency) * 15, (100 - concentration) * 15, (100 - hygiene) * 10]) AS lost FROM h) x) y WHERE rn = 1)
"""


@query("health_scores", "A-39", sql=HEALTH_SQL + "SELECT h.*, part AS top_lever FROM health h JOIN lev USING (org_id)")
def health_scores(b):
    return insights.health_scores(b.ledger, b.customers, b.organizations, TTM)


ANOMALY = f"""
, mo AS (SELECT org_id, label, date_trunc('month', occurred_at) AS m, SUM(minor) AS y FROM base WHERE statement IN ('opex', 'cogs', 'payroll') AND occurred_at BETWEEN DATE '2000-07-01' AND DATE '2001-07-31' GROUP BY 1, 2, 3),
pl AS (SELECT org_id, label, COALESCE(SUM(CASE WHEN m = DATE '2001-07-01' THEN y END), 0) AS cur, COUNT(CASE WHEN m <> DATE '2001-07-01' THEN 1 END) AS n,
  SUM(CASE WHEN m <> DATE '2001-07-01' THEN y END) AS s1, SUM(CASE WHEN m <> DATE '2001-07-01' THEN CAST(y AS HUGEINT) * y END) AS s2 FROM mo GROUP BY 1, 2),
an AS (SELECT *, SUM(cur) OVER (PARTITION BY org_id) AS month_minor, {d('s1')} / {d('n')} AS mean,
  SQRT(GREATEST({d('n')} * {d('s2')} - {d('s1')} * {d('s1')}, {d(0)})) / {d('n')} AS sd FROM pl),
anomalies AS (SELECT org_id, label, CAST(cur AS BIGINT) AS current_minor, CAST(FLOOR(mean + 0.5) AS BIGINT) AS mean_minor, CAST(FLOOR({d('cur')} - mean + 0.5) AS BIGINT) AS excess_minor FROM an
  WHERE n >= 2 AND {d('cur')} > mean + {d(2.5)} * sd AND ({d('cur')} - mean) * 100 > {d('month_minor')} * 3)
"""


@query("expense_anomalies", "A-40", sql=ANOMALY + "SELECT * FROM anomalies")
def expense_anomalies(b):
    return insights.expense_anomalies(b.ledger, month_period(2001, 7))


@query(
    "data_quality_rate",
    "A-41",
    sql=f"""SELECT org_id, COUNT(*) AS n, COUNT(CASE WHEN category IS NULL THEN 1 END) AS uncategorized_n, CAST(SUM(minor) AS BIGINT) AS total_minor, CAST(SUM(CASE WHEN category IS NULL THEN minor ELSE 0 END) AS BIGINT) AS uncategorized_minor,
{d("COUNT(CASE WHEN category IS NULL THEN 1 END)")} / {d('COUNT(*)')} AS uncategorized_share, {d("SUM(CASE WHEN category IS NULL THEN minor ELSE 0 END)")} / {d('SUM(minor)')} AS uncategorized_amount_share
FROM base WHERE statement IN ('opex', 'cogs', 'payroll') GROUP BY 1""",
)
def data_quality_rate(b):
    return quality_rate(b.ledger)


# --- product events ---------------------------------------------------------

STEPS = ("signup", "view", "click", "purchase")


def product_events(b):
    return b.table("events").withColumn("ts", F.col("ts").cast("timestamp"))


def rate(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN FLOOR({d(part)} / {d(whole)} * {d(10000)} + {d(0.5)}) / {d(10000)} END"


@query(
    "product_funnel",
    "A-42",
    sql=f"""WITH f AS (SELECT user_id, MIN(CASE WHEN event_type = 'signup' THEN ts END) AS a, MIN(CASE WHEN event_type = 'view' THEN ts END) AS b, MIN(CASE WHEN event_type = 'click' THEN ts END) AS c, MIN(CASE WHEN event_type = 'purchase' THEN ts END) AS e FROM events GROUP BY 1),
n AS (SELECT COUNT(a) AS n1, COUNT(CASE WHEN b >= a THEN 1 END) AS n2, COUNT(CASE WHEN b >= a AND c >= b THEN 1 END) AS n3, COUNT(CASE WHEN b >= a AND c >= b AND e >= c THEN 1 END) AS n4 FROM f)
SELECT 1 AS step_no, 'signup' AS step, n1 AS users, {rate('n1', 'n1')} AS conversion FROM n UNION ALL SELECT 2, 'view', n2, {rate('n2', 'n1')} FROM n UNION ALL SELECT 3, 'click', n3, {rate('n3', 'n2')} FROM n UNION ALL SELECT 4, 'purchase', n4, {rate('n4', 'n3')} FROM n""",
    views=False,
)
def product_funnel(b):
    return product.funnel(product_events(b), STEPS)


WEEKS = """WITH f AS (SELECT user_id, MIN(CAST(ts AS DATE)) AS first_day FROM events GROUP BY 1),
w AS (SELECT DISTINCT e.user_id, first_day, CAST((CAST(ts AS DATE) - first_day) // 7 AS INT) AS week_no FROM events e JOIN f USING (user_id))
"""


@query(
    "event_cohorts",
    "A-42",
    sql=WEEKS + "SELECT CAST(date_trunc('week', first_day) AS DATE) AS cohort, week_no, COUNT(*) AS users FROM w GROUP BY 1, 2",
    views=False,
)
def event_cohorts(b):
    return product.cohorts(product_events(b))


@query(
    "week_four_retention",
    "A-42",
    sql=WEEKS
    + f"SELECT users, active, {rate('active', 'users')} AS retention FROM (SELECT COUNT(CASE WHEN week_no = 0 THEN 1 END) AS users, COUNT(CASE WHEN week_no = 3 THEN 1 END) AS active FROM w) x",
    views=False,
)
def week_four_retention(b):
    return product.week_retention(product_events(b))


@query(
    "weekly_error_rate",
    "A-42",
    sql=f"""SELECT *, rate > 0.15 AS above_limit FROM (SELECT week, part_n, whole_n, {rate('part_n', 'whole_n')} AS rate FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, COUNT(CASE WHEN event_type = 'error' THEN 1 END) AS part_n, COUNT(CASE WHEN event_type = 'view' THEN 1 END) AS whole_n FROM events GROUP BY 1) x) y""",
    views=False,
)
def weekly_error_rate(b):
    return product.weekly_rates(product_events(b), "error", "view", 0.15)


@query(
    "trace_rollup",
    "A-43",
    sql="""SELECT 'v' || (CAST(json_extract(props, '$.k') AS INT) % 4) AS prompt_version, COUNT(*) AS answers, COUNT(CASE WHEN event_type = 'error' THEN 1 END) AS violations,
ROUND(quantile_cont(FLOOR(value * 10), 0.5), 4) AS latency_p50, ROUND(quantile_cont(FLOOR(value * 10), 0.95), 4) AS latency_p95, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS cost_minor FROM events GROUP BY 1""",
    views=False,
)
def trace_rollup(b):
    """Events as answer traces: the version from their properties, errors as violations."""
    k = F.get_json_object("props", "$.k").cast("int")
    traces = b.table("events").select(
        F.concat(F.lit("v"), (k % 4).cast("string")).alias("prompt_version"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("grounding_violations"),
        F.floor(F.col("value") * 10).alias("latency_ms"),
        F.round(F.col("value") * 100).cast("bigint").alias("cost_minor"),
    )
    return product.trace_rollup(traces)


ACCESS_SQL = f"""WITH dl AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1, 2),
w AS (SELECT *, COUNT(*) OVER r AS seen, SUM(n) OVER r AS s1, SUM(n * n) OVER r AS s2 FROM dl WINDOW r AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
m AS (SELECT *, {d('s1')} / {d('seen')} AS mean, SQRT(GREATEST({d('seen')} * {d('s2')} - {d('s1')} * {d('s1')}, {d(0)})) / {d('seen')} AS sd FROM w)
SELECT user_id, day, n, FLOOR(mean * {d(10000)} + {d(0.5)}) / {d(10000)} AS trailing_mean FROM m WHERE seen >= 3 AND {d('n')} > mean + {d(2)} * sd"""


@query("access_anomalies", "A-51", sql=ACCESS_SQL, views=False)
def access_anomalies(b):
    return insights.access_anomalies(product_events(b).select("user_id", F.to_date("ts").alias("day")))


# --- registry, models, tax, leaks -------------------------------------------


@query(
    "metric_availability",
    "A-48",
    sql=""", s AS (SELECT org_id, MAX(occurred_at) - MIN(occurred_at) AS days FROM ledger_c WHERE is_canonical AND NOT is_voided GROUP BY 1),
c AS (SELECT CAST(c_nationkey AS INT) AS org_id, bool_or(c_mktsegment = 'MACHINERY') AS acc, bool_or(c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 8000) AS bank FROM customer WHERE NOT c_acctbal > 9500 GROUP BY 1),
r(metric_key, kind, need) AS (VALUES ('revenue', 'a', 0), ('cogs', 'a', 0), ('gross_margin', 'a', 60), ('operating_expenses', 'a', 0), ('net_profit', 'a', 30), ('cash_position', 'b', 0), ('monthly_burn', 'b', 60), ('runway_months', 'b', 60))
SELECT s.org_id, r.metric_key, CASE WHEN NOT COALESCE(CASE kind WHEN 'a' THEN acc ELSE bank END, FALSE) THEN 'requires_connection' WHEN COALESCE(days, 0) < need THEN 'insufficient_data' ELSE 'available' END AS state
FROM s CROSS JOIN r LEFT JOIN c ON c.org_id = s.org_id""",
)
def metric_availability(b):
    spans = live(b.ledger).groupBy("org_id").agg(
        F.datediff(F.max("occurred_at"), F.min("occurred_at")).alias("history_days")
    )
    kinds = live_connections(connections(b)).join(
        b.table("customer").select(F.col("c_custkey").alias("connection_id"), "c_acctbal"), "connection_id"
    )
    named = kinds.select(
        "org_id",
        F.when(F.col("source_kind") == "machinery", "accounting")
        .when((F.col("source_kind") == "household") & (F.col("c_acctbal") > 8000), "banking")
        .otherwise(F.col("source_kind"))
        .alias("source_kind"),
    )
    return insights.metric_availability(spans, named)


@query(
    "subscription_metrics",
    "A-50",
    sql=f""", e AS (SELECT n_nationkey AS org_id FROM nation WHERE n_regionkey = 1),
pc AS (SELECT org_id, CASE WHEN statement = 'revenue' THEN customer_id END AS c, SUM(CASE WHEN statement = 'revenue' AND occurred_at > DATE '2001-05-01' THEN minor END) AS nowm, SUM(CASE WHEN statement = 'revenue' AND occurred_at <= DATE '2001-05-01' THEN minor END) AS bef,
  SUM(CASE WHEN statement = 'opex' AND occurred_at > DATE '2001-05-01' THEN minor END) AS mk FROM base WHERE org_id IN (SELECT org_id FROM e) AND (statement = 'revenue' OR statement = 'opex' AND category = 'Brand#2' AND occurred_at > DATE '2001-05-01') AND occurred_at > DATE '2001-02-01' AND occurred_at <= DATE '2001-08-01' GROUP BY 1, 2),
po AS (SELECT org_id, COALESCE(SUM(CASE WHEN bef IS NOT NULL THEN nowm END), 0) AS rec, COALESCE(SUM(nowm), 0) AS rev, SUM(mk) AS mk, COUNT(bef) AS earlier, COUNT(CASE WHEN bef IS NOT NULL AND nowm IS NULL THEN 1 END) AS lost,
  COUNT(CASE WHEN bef IS NULL AND nowm IS NOT NULL THEN 1 END) AS gained, COUNT(nowm) AS active FROM pc GROUP BY 1)
SELECT org_id, CAST((2 * rec + 3) // 6 AS BIGINT) AS mrr_minor, CAST((2 * rec + 3) // 6 * 12 AS BIGINT) AS arr_minor, CASE WHEN earlier > 0 THEN FLOOR({d('lost')} / {d('earlier')} * {d(10000)} + {d(0.5)}) / {d(10000)} END AS churn,
CAST(CASE WHEN gained > 0 THEN (2 * mk + gained) // (2 * gained) END AS BIGINT) AS cac_minor,
CAST(CASE WHEN lost > 0 AND active > 0 THEN FLOOR(CAST((2 * rev + active * 3) // (2 * active * 3) AS DOUBLE) * 3 / ({d('lost')} / {d('earlier')}) + {d(0.5)}) END AS BIGINT) AS ltv_minor FROM po""",
)
def subscription_metrics(b):
    models = b.table("nation").select(
        F.col("n_nationkey").alias("org_id"),
        F.when(F.col("n_regionkey") == 1, "subscription").otherwise("services").alias("model"),
    )
    # the books' second brand stands for the marketing account
    return insights.subscription_metrics(b.ledger, models, AS_OF, marketing_categories=("Brand#2",))


@query(
    "seasonal_index",
    "2.10",
    sql=f""", mo AS (SELECT org_id, date_trunc('month', occurred_at) AS m, SUM(minor) AS y FROM base WHERE statement = 'opex' AND occurred_at BETWEEN DATE '1999-08-01' AND DATE '2001-07-31' GROUP BY 1, 2),
g AS (SELECT org_id, CAST(month(m) AS INT) AS month_of_year, SUM(y) AS y, COUNT(*) AS n FROM mo GROUP BY 1, 2)
SELECT org_id, month_of_year, FLOOR({d('y')} / {d('n')} / ({d('SUM(y) OVER w')} / {d('SUM(n) OVER w')}) * {d(10000)} + {d(0.5)}) / {d(10000)} AS seasonal_index FROM g WINDOW w AS (PARTITION BY org_id)""",
)
def seasonal_index(b):
    return insights.seasonal_index(b.ledger, "opex", Period(dt.date(1999, 8, 1), dt.date(2001, 7, 31)))


@query(
    "tax_set_aside",
    "2.10",
    sql="""SELECT org_id, CAST(p AS BIGINT) AS profit_minor, CAST(ROUND(CAST(GREATEST(p, 0) AS DECIMAL(19,0)) * CASE WHEN n_regionkey = 0 THEN 0.25 ELSE 0.21 END) AS BIGINT) AS set_aside_minor FROM (
SELECT org_id, SUM(CASE WHEN statement = 'revenue' THEN minor ELSE -minor END) AS p FROM base WHERE statement IN ('revenue', 'cogs', 'opex', 'payroll') AND occurred_at BETWEEN DATE '2001-01-01' AND DATE '2001-08-01' GROUP BY 1) x JOIN nation ON n_nationkey = org_id""",
)
def tax_set_aside(b):
    rates = b.table("nation").select(
        F.col("n_nationkey").alias("org_id"),
        F.when(F.col("n_regionkey") == 0, F.lit("0.25")).otherwise(F.lit("0.21")).cast("decimal(4,2)").alias("rate"),
    )
    return insights.tax_set_aside(b.ledger, Period(dt.date(2001, 1, 1), AS_OF), rates)


@query(
    "outgrowing_categories",
    "2.10",
    sql=f""", g AS (SELECT org_id, CASE WHEN statement <> 'revenue' THEN label END AS label, COALESCE(SUM(CASE WHEN occurred_at >= DATE '2001-02-01' THEN minor END), 0) AS a, COALESCE(SUM(CASE WHEN occurred_at < DATE '2001-02-01' THEN minor END), 0) AS b
  FROM base WHERE statement IN ('revenue', 'opex', 'cogs', 'payroll') AND occurred_at BETWEEN DATE '2000-08-03' AND DATE '2001-08-01' GROUP BY 1, 2),
r AS (SELECT org_id, {d('a')} / {d('b')} AS base_g FROM g WHERE label IS NULL AND b > 0), c AS (SELECT *, {d('a')} / {d('b')} AS gr FROM g WHERE label IS NOT NULL AND b > 0)
SELECT org_id, label, CAST(a AS BIGINT) AS now_minor, CAST(b AS BIGINT) AS before_minor, FLOOR((gr * 100 - 100) * {d(100)} + {d(0.5)}) / {d(100)} AS growth_pct, FLOOR((base_g * 100 - 100) * {d(100)} + {d(0.5)}) / {d(100)} AS revenue_growth_pct
FROM c JOIN r USING (org_id) WHERE gr > base_g AND a > b""",
)
def outgrowing_categories(b):
    return insights.outgrowing_categories(b.ledger, Period(dt.date(2001, 2, 1), AS_OF))
