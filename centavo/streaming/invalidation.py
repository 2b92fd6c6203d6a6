"""Which tenant months a change touches, and recomputing only those."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centavo.functions.periods import month_start
from centavo.operators.metrics import _series
from centavo.operators.predicates import analytical


def touched_months(changes: DataFrame) -> DataFrame:
    """Distinct (tenant, month) of changed rows, by accrual and by cash date."""
    days = F.explode(F.array(F.col("occurred_at"), F.col("posted_at"))).alias("day")
    return (
        changes.select("org_id", days)
        .where(F.col("day").isNotNull())
        .select("org_id", month_start(F.col("day")).alias("month"))
        .distinct()
    )


def recompute(ledger: DataFrame, touched: DataFrame) -> DataFrame:
    """Monthly profit and loss of the touched months only.

    The touched set is one row per tenant and month, so the semi join is small;
    ledger rows of other months never reach the aggregation.
    """
    rows = analytical(ledger).withColumn("month", month_start(F.col("occurred_at")))
    affected = rows.join(touched, ["org_id", "month"], "left_semi")
    return _series(affected, F.col("month"), "month")


def refresh_on_change(
    ledger: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]
) -> Callable[[DataFrame, int], None]:
    """Batch function for a change stream: recompute what the batch touched."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(recompute(ledger(), touched_months(batch)), batch_id)

    return run
