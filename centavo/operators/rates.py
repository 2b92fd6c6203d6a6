"""Amounts in the base currency at dated rates: the last rate on or before the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centavo.operators.versions import lookup


def rates_on(days: DataFrame, rates: DataFrame) -> DataFrame:
    """For each (currency, day) of `days` the last rate on or before it: `currency, day, rate, rate_day`.

    `rates`: `currency, day, rate`; of several on one day the largest counts. Days and rates of a currency are laid in one order
    and the last rate is carried forward, so no day is compared with every rate. The window runs over calendar days.
    """
    asked = days.select("currency", "day").where("currency IS NOT NULL AND day IS NOT NULL").distinct()
    known = rates.where("rate IS NOT NULL").groupBy("currency", "day").agg(F.max("rate").alias("rate"))
    both = asked.withColumn("asked", F.lit(True)).join(known, ["currency", "day"], "full_outer")
    upto = Window.partitionBy("currency").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("rate").isNotNull(), F.struct("rate", F.col("day").alias("rate_day"))), ignorenulls=True).over(upto)
    carried = both.withColumn("last", last).where("asked")
    return carried.select("currency", "day", "last.rate", "last.rate_day")


def converted(amount: Column, rate: Column) -> Column:
    """Amount in the base currency at four decimals."""
    return F.round(amount.cast("decimal(20,4)") * rate.cast("decimal(18,10)"), 4).cast("decimal(20,4)")


def to_base(rows: DataFrame, rates: DataFrame, base: str, amount: str, row_id: str) -> DataFrame:
    """Adds `rate`, `rate_day`, `base_amount` and `rate_missing` to rows with `currency` and `day`.

    Rows of one currency and day share one lookup: their distinct pairs, a row per currency and calendar day, are
    resolved first and joined back. A row in the base currency has rate 1. A row without a rate on or before its day, or
    without a currency or day, has no base amount and is reported as missing.
    """
    foreign = rows.where(F.col("currency") != base)
    found = lookup(rows, rates_on(foreign, rates), ["currency", "day"], row_id)
    own = F.col("currency").eqNullSafe(base)
    rate = F.when(own, F.lit(1).cast("decimal(18,10)")).otherwise(F.col("rate").cast("decimal(18,10)"))
    out = found.withColumn("rate", rate).withColumn("rate_day", F.when(own, F.col("day")).otherwise(F.col("rate_day")))
    return out.withColumns({"base_amount": converted(F.col(amount), F.col("rate")), "rate_missing": F.col("rate").isNull()})
