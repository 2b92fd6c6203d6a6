"""Weekly and monthly report content, and forecast scoring."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centavo.functions.money import minor, round_half_up, signed
from centavo.functions.periods import Period, month_period, shift_months
from centavo.operators import metrics
from centavo.operators.predicates import analytical, settled
from centavo.plans import forecast as fc

REPORT_METRICS = ("revenue", "cogs", "operating_expenses", "net_profit")
HORIZONS = (7, 30, 90)


def monthly_report(ledger: DataFrame, organizations: DataFrame, month: Period) -> DataFrame:
    """Profit and loss of a month beside the month before and the same month a year ago, from one scan."""
    before = shift_months(month.start, -1)
    periods = {
        "current": month,
        "prior_month": month_period(before.year, before.month),
        "prior_year": month_period(month.start.year - 1, month.start.month),
    }
    table = metrics.metric_batch(
        ledger, [metrics.MetricRequest(p, REPORT_METRICS) for p in periods.values()], organizations
    )
    sums = [
        F.max(F.when(F.col("period_start") == F.lit(p.start), F.col("value_minor"))).alias(f"{name}_minor")
        for name, p in periods.items()
    ]
    return (
        table.groupBy("org_id", "metric_key")
        .agg(*sums)
        .withColumn("change_minor", F.col("current_minor") - F.col("prior_month_minor"))
        .withColumn("year_change_minor", F.col("current_minor") - F.col("prior_year_minor"))
    )


def coming_up(inputs: DataFrame, o: fc.ForecastOptions, days: int = 14) -> DataFrame:
    """Committed items of the next days: pay runs and usual vendor payments."""
    rows = fc.day_deltas(inputs, o).where(F.col("day") <= days)
    items = F.array(
        F.struct(F.lit("payroll").alias("kind"), F.coalesce("run_minor", F.lit(0).cast("bigint")).alias("amount_minor")),
        F.struct(F.lit("vendors").alias("kind"), F.col("vendor_minor").alias("amount_minor")),
    )
    return (
        rows.select("org_id", "date", F.explode(items).alias("i"))
        .select("org_id", "date", "i.*")
        .where(F.col("amount_minor") > 0)
    )


def balances_at(ledger: DataFrame, days: Sequence[dt.date]) -> DataFrame:
    """Settled cash at several dates from one scan: one row per tenant and date."""
    flow = signed("direction", minor("amount"))
    rows = analytical(ledger).where(settled(max(days)))
    sums = rows.groupBy("org_id").agg(
        *[F.coalesce(F.sum(F.when(settled(d), flow)), F.lit(0).cast("bigint")).alias(f"b{i}") for i, d in enumerate(days)]
    )
    packed = F.array(*[F.struct(F.lit(d).alias("date"), F.col(f"b{i}").alias("actual_minor")) for i, d in enumerate(days)])
    return sums.select("org_id", F.explode(packed).alias("p")).select("org_id", "p.*")


def score_forecast(points: DataFrame, ledger: DataFrame, as_of: dt.date, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Absolute error of P50 and whether the actual lay in the band, per tenant and horizon."""
    dates = [as_of + dt.timedelta(days=h) for h in horizons]
    actual = balances_at(ledger, dates)
    error = F.abs(F.col("p50") - F.col("actual_minor")).cast("double") / F.abs("actual_minor").cast("double")
    return points.join(actual, ["org_id", "date"]).select(
        "org_id",
        F.datediff(F.col("date"), F.lit(as_of)).alias("horizon_days"),
        F.col("p50").alias("predicted_minor"),
        "actual_minor",
        F.when(F.col("actual_minor") != 0, round_half_up(error, 6)).alias("abs_pct_error"),
        F.col("actual_minor").between(F.col("p10"), F.col("p90")).alias("within_band"),
    )


def accuracy(scores: DataFrame) -> DataFrame:
    """Mean error and share inside the band by horizon."""
    micro = F.round(F.col("abs_pct_error") * 1_000_000).cast("bigint")
    inside = F.count(F.when(F.col("within_band"), 1)).cast("double") / F.count("*").cast("double")
    return scores.groupBy("horizon_days").agg(
        F.count("*").alias("n"),
        round_half_up(F.sum(micro).cast("double") / F.count(micro).cast("double") / F.lit(1_000_000.0), 6).alias("mape"),
        round_half_up(inside, 4).alias("band_rate"),
    )


