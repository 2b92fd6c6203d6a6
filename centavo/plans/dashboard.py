"""Everything a tenant's dashboard shows, computed for all tenants at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centavo.functions.periods import last_days, month_of, month_period, previous, shift_months, trailing_months
from centavo.operators import breakdowns, metrics
from centavo.plans import forecast as fc

CARD_METRICS = ("cash_position", "runway_months", "revenue", "net_profit", "operating_expenses", "monthly_burn")


def card_requests(as_of: dt.date) -> list[metrics.MetricRequest]:
    before = shift_months(as_of.replace(day=1), -1)
    return [
        metrics.MetricRequest(trailing_months(as_of, 12), CARD_METRICS),
        metrics.MetricRequest(month_of(as_of), ("gross_margin",)),
        metrics.MetricRequest(month_period(before.year, before.month), ("gross_margin",)),
    ]


def cards(ledger: DataFrame, organizations: DataFrame, as_of: dt.date) -> DataFrame:
    """Headline figures: trailing twelve months, this month's margin and last month's."""
    return metrics.metric_batch(ledger, card_requests(as_of), organizations)


def dashboard(
    ledger: DataFrame,
    invoices: DataFrame,
    customers: DataFrame,
    organizations: DataFrame,
    as_of: dt.date,
) -> dict[str, DataFrame]:
    """The parts of the dashboard by name; each is a lazy frame keyed by tenant.

    The 30-day comparison uses two windows of equal length.
    """
    year = trailing_months(as_of, 12)
    recent = last_days(as_of, 30)
    options = fc.ForecastOptions(as_of=as_of)
    facts = fc.forecast_inputs(ledger, invoices, organizations, options, customers)
    return {
        "cards": cards(ledger, organizations, as_of),
        "series": metrics.monthly_series(ledger, as_of, 24),
        "by_category": breakdowns.expenses_by_category(ledger, year),
        "by_customer": breakdowns.revenue_by_customer(ledger, customers, year),
        "aging": breakdowns.receivables_aging(invoices, as_of),
        "concentration": breakdowns.concentration(ledger, customers, year),
        "drivers": breakdowns.top_drivers(breakdowns.expense_change(ledger, recent, previous(recent))),
        "forecast_points": fc.forecast_points(facts, options),
        "forecast_risks": fc.forecast_risks(facts, options),
        "forecast_assumptions": fc.forecast_assumptions(facts),
    }


# The figure of each part that a refresh is checked by.
TOTALS = {
    "cards": "value_minor",
    "series": "profit_minor",
    "by_category": "total_minor",
    "by_customer": "total_minor",
    "aging": "balance_minor",
    "concentration": "total_minor",
    "drivers": "delta_minor",
    "forecast_points": "p50",
    "forecast_risks": "shortfall_minor",
}


def bundle(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows and the sum of the main figure per tenant and part, one frame: what a refresh wrote."""

    def told(name: str, df: DataFrame) -> DataFrame:
        total = F.sum(TOTALS[name]) if name in TOTALS else F.lit(None)
        return df.groupBy("org_id").agg(F.count("*").alias("n"), total.cast("bigint").alias("total_minor")).select("org_id", F.lit(name).alias("part"), "n", "total_minor")

    counted = [told(name, df) for name, df in parts.items()]
    out = counted[0]
    for frame in counted[1:]:
        out = out.unionByName(frame)
    return out
