"""How late each customer pays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centavo.functions.money import round_half_up

MIN_SAMPLES = 4


def paid_lags(invoices: DataFrame) -> DataFrame:
    """Days late per paid invoice that has a customer and both dates."""
    return invoices.where(
        (F.col("status") == "paid")
        & F.col("paid_on").isNotNull()
        & F.col("due_date").isNotNull()
        & F.col("customer_id").isNotNull()
    ).select(
        "org_id",
        "customer_id",
        F.datediff("paid_on", "due_date").cast("bigint").alias("days_late"),
    )


def _moments() -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.sum("days_late").alias("s1"),
        F.sum(F.col("days_late") * F.col("days_late")).alias("s2"),
    ]


def _mean() -> Column:
    return F.col("s1").cast("double") / F.col("n").cast("double")


def _stddev() -> Column:
    """Population deviation from integer moments: the same in any order of rows."""
    n, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
    return F.sqrt((n * s2 - s1 * s1).cast("double")) / n.cast("double")


def fit_behavior(invoices: DataFrame) -> DataFrame:
    """Mean, deviation and interpolated percentiles of days late per customer.

    The percentile buffer counts distinct day values, so it stays small however
    many invoices one customer has.
    """
    fitted = (
        paid_lags(invoices)
        .groupBy("org_id", "customer_id")
        .agg(*_moments(), F.percentile("days_late", F.array(F.lit(0.5), F.lit(0.9))).alias("p"))
    )
    return fitted.select(
        "org_id",
        "customer_id",
        round_half_up(_mean(), 2).alias("mean_days_late"),
        round_half_up(_stddev(), 2).alias("stddev"),
        F.round(F.col("p")[0], 4).alias("p50"),
        F.round(F.col("p")[1], 4).alias("p90"),
        F.col("n").alias("sample_count"),
    )


def fit_behavior_by_rank(invoices: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """The same fit with percentiles taken at index floor(n * q), few samples left out.

    Works on counts per distinct lag, so the running count spans a bounded
    number of rows per customer.
    """
    counts = paid_lags(invoices).groupBy("org_id", "customer_id", "days_late").agg(F.count("*").alias("c"))
    per = Window.partitionBy("org_id", "customer_id")
    running = per.orderBy("days_late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lag, c = F.col("days_late"), F.col("c")
    ranked = counts.withColumn("seen", F.sum("c").over(running)).withColumn("n", F.sum("c").over(per))

    def at(q: float) -> Column:
        return F.min(F.when(F.col("seen") > F.floor(F.col("n") * F.lit(q)), lag))

    fitted = ranked.groupBy("org_id", "customer_id").agg(
        F.max("n").alias("n"),
        F.sum(lag * c).alias("s1"),
        F.sum(lag * lag * c).alias("s2"),
        at(0.5).alias("p50"),
        at(0.9).alias("p90"),
    )
    return fitted.where(F.col("n") >= min_samples).select(
        "org_id",
        "customer_id",
        round_half_up(_mean(), 6).alias("mean_days_late"),
        round_half_up(_stddev(), 6).alias("stddev"),
        "p50",
        "p90",
        F.col("n").alias("sample_count"),
    )


def with_behavior(customers: DataFrame, behavior: DataFrame) -> DataFrame:
    """Customers with their fitted behaviour as a struct; null when never fitted."""
    fields = ("mean_days_late", "stddev", "p50", "p90", "sample_count")
    packed = behavior.select("org_id", "customer_id", F.struct(*fields).alias("payment_behavior"))
    return customers.join(packed, ["org_id", "customer_id"], "left")
