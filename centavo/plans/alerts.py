"""Alert candidates from the metric and forecast frames, their ranking and life cycle.

Every frame here holds a few rows per tenant: candidates are exceptions, and
the analyses they come from are already reduced to tenant, category or vendor.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centavo.operators.versions import top_per

# Severity order, and the days before the due date on which an
# ignored alert is repeated.
SEVERITIES = ("critical", "high", "medium", "info")
REPEAT_DAYS = (7, 2)
WEEKLY_LIMIT = 2

COLUMNS = ("org_id", "rule_key", "severity", "due_on", "dedup_key", "materiality_minor")


def _alert(df: DataFrame, rule: str, severity: Column | str, subject: Column, materiality: Column, due: Column | None = None) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(
        "org_id",
        F.lit(rule).alias("rule_key"),
        level.alias("severity"),
        (F.lit(None).cast("date") if due is None else due).alias("due_on"),
        F.concat_ws(":", F.lit(rule), subject.cast("string")).alias("dedup_key"),
        materiality.cast("bigint").alias("materiality_minor"),
    )


def from_forecast(risks: DataFrame) -> DataFrame:
    """payroll at risk, cash shortfall, runway below threshold."""
    return risks.select(
        "org_id",
        F.col("kind").alias("rule_key"),
        "severity",
        F.col("date").alias("due_on"),
        F.concat_ws(":", F.col("kind"), F.col("date").cast("string")).alias("dedup_key"),
        F.col("shortfall_minor").alias("materiality_minor"),
    )


def large_expense(bills: DataFrame, cash: DataFrame, percent: int = 10) -> DataFrame:
    """Unpaid bills above a share of the cash on hand. `bills`: org_id, bill_id, due_on, amount_minor."""
    covered = bills.join(cash.select("org_id", "cash_minor"), "org_id")
    large = covered.where(F.col("amount_minor") * 100 > F.greatest("cash_minor", F.lit(0)) * percent)
    return _alert(large, "large_expense_due", "high", F.col("bill_id"), F.col("amount_minor"), F.col("due_on"))


def revenue_decline(comparison: DataFrame, percent: int = 20) -> DataFrame:
    """Revenue of the recent window below the one before by more than a share."""
    now, before = F.col("current_revenue_minor"), F.col("prior_revenue_minor")
    fell = comparison.where((before > 0) & ((before - now) * 100 > before * percent))
    return _alert(fell, "revenue_decline", "high", F.lit("trend"), before - now)


def margin_compression(margins: DataFrame, points: float = 5.0) -> DataFrame:
    fell = margins.where(F.col("delta_points") <= -points)
    return _alert(fell, "margin_compression", "medium", F.lit("month"), F.lit(0))


def expense_anomaly(anomalies: DataFrame) -> DataFrame:
    return _alert(anomalies, "expense_anomaly", "medium", F.col("label"), F.col("excess_minor"))


def overdue_key_customer(overdue: DataFrame, percent: int = 10) -> DataFrame:
    """Customers whose overdue balance is a large part of all open receivables.

    `overdue`: `org_id, customer_id, overdue_minor`; tenant totals are joined
    back rather than taken in a window over the tenant.
    """
    totals = overdue.groupBy("org_id").agg(F.sum("overdue_minor").alias("org_minor"), F.count("customer_id").alias("customers"))
    large = overdue.join(totals, "org_id").where(F.col("overdue_minor") * 100 > F.col("org_minor") * percent)
    return _alert(large, "key_customer_overdue", "high", F.col("customer_id"), F.col("overdue_minor"))


def concentration_breach(concentration: DataFrame) -> DataFrame:
    return _alert(
        concentration.where("concentrated"), "customer_concentration", "medium", F.col("customer"), F.col("total_minor")
    )


def vendor_creep(series: DataFrame, percent: float = 20.0) -> DataFrame:
    rising = series.where(F.col("trend_pct_per_year") > percent)
    yearly = F.col("typical_minor") * 12
    return _alert(rising, "vendor_creep", "info", F.col("vendor"), yearly)


def tax_due(set_aside: DataFrame, due_on: dt.date) -> DataFrame:
    owed = set_aside.where(F.col("set_aside_minor") > 0)
    return _alert(owed, "estimated_tax", "high", F.lit(due_on), F.col("set_aside_minor"), F.lit(due_on))


def candidates(*frames: DataFrame) -> DataFrame:
    out = frames[0].select(*COLUMNS)
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*COLUMNS))
    return out


def _order(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def select_for_week(alerts: DataFrame, limit: int = WEEKLY_LIMIT) -> DataFrame:
    """The most severe and material few per tenant; critical ones pass outside the limit."""
    critical = alerts.where(F.col("severity") == "critical").withColumn("rank", F.lit(0))
    others = alerts.where(F.col("severity") != "critical")
    order = [_order(F.col("severity")), F.col("materiality_minor").desc(), F.col("dedup_key")]
    return critical.unionByName(top_per(others, ["org_id"], order, limit))


def unseen(alerts: DataFrame, known: DataFrame) -> DataFrame:
    """Alerts whose dedup key has not fired for the tenant before."""
    return alerts.join(known.select("org_id", "dedup_key"), ["org_id", "dedup_key"], "left_anti")


def lifecycle(today: DataFrame, open_alerts: DataFrame, as_of: dt.date) -> DataFrame:
    """What to do with each alert: new, repeat, ongoing, resolved, or suppressed when dismissed.

    `open_alerts`: `org_id, dedup_key, state` as left by the previous run.
    """
    fired = today.select("org_id", "dedup_key", "severity", "due_on", F.lit(True).alias("fires"))
    before = open_alerts.select("org_id", "dedup_key", F.col("state").alias("previous_state"))
    days = F.datediff(F.col("due_on"), F.lit(as_of))
    fires, previous = F.col("fires").isNotNull(), F.col("previous_state")
    action = (
        F.when(~fires & (previous == "dismissed"), "forgotten")
        .when(~fires, "resolved")
        .when(previous == "dismissed", "suppressed")
        .when(previous.isNull(), "new")
        .when((previous == "sent") & days.isin(*REPEAT_DAYS), "repeat")
        .otherwise("ongoing")
    )
    return fired.join(before, ["org_id", "dedup_key"], "full_outer").select(
        "org_id", "dedup_key", "severity", "due_on", "previous_state", action.alias("action")
    )


def firm_console(
    grants: DataFrame, health: DataFrame, runway: DataFrame, alerts: DataFrame, freshness: DataFrame
) -> DataFrame:
    """Roll-ups of the clients a firm may see, those that need attention first.

    `grants`: `firm_id, org_id`. Only per-tenant roll-ups are read; no
    transaction-level frame is widened.
    """
    granted = grants.select("org_id").distinct()
    critical = (
        alerts.join(granted, "org_id", "left_semi")
        .groupBy("org_id")
        .agg(F.count(F.when(F.col("severity") == "critical", 1)).alias("critical_alerts"))
    )
    stale = freshness.groupBy("org_id").agg(
        F.max("last_sync_at").alias("last_sync_at"), F.bool_or("has_degraded_connection").alias("degraded")
    )
    rows = (
        grants.join(health.select("org_id", "score"), "org_id", "left")
        .join(runway.select("org_id", "runway_months"), "org_id", "left")
        .join(critical, "org_id", "left")
        .join(stale, "org_id", "left")
        .withColumn("critical_alerts", F.coalesce("critical_alerts", F.lit(0).cast("bigint")))
    )
    return rows.orderBy("firm_id", F.col("critical_alerts").desc(), F.col("score").asc_nulls_first(), "org_id")
