"""What-if forecasts: overrides of the same per-tenant inputs, then the same composition."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centavo.functions.money import scale_minor
from centavo.plans import forecast as fc

# Fixed value: loaded cost of an employee relative to base pay.
BURDEN = "1.30"


@dataclass(frozen=True)
class Scenario:
    """Changes to the forecast of every tenant in the frame it is applied to.

    `monthly_cost_minor` (a hire's base pay before burden, a lease) and
    `monthly_revenue_minor` fall on the first of each month from `from_day`;
    `one_off_minor` moves cash once, on `from_day`; `revenue_factor` scales new
    revenue (a price change); `collection_delay_days` moves every receivable.
    """

    name: str
    from_day: int = 1
    monthly_cost_minor: int = 0
    burdened: bool = False
    monthly_revenue_minor: int = 0
    one_off_minor: int = 0
    revenue_factor: str = "1"
    collection_delay_days: int = 0


def apply(inputs: DataFrame, s: Scenario) -> DataFrame:
    """Inputs with the scenario's factors in place."""
    moved = F.transform(
        "receivables",
        lambda e: F.struct((e["day"] + s.collection_delay_days).alias("day"), e["balance_minor"].alias("balance_minor")),
    )
    return inputs.withColumns(
        {
            "receivables": moved,
            "new_revenue_minor": scale_minor("new_revenue_minor", s.revenue_factor),
            "collection_lag_days": F.col("collection_lag_days") + s.collection_delay_days,
        }
    )


def _on_firsts(amount: Column, s: Scenario) -> Column:
    hit = (F.dayofmonth("date") == 1) & (F.col("day") >= s.from_day)
    return F.when(hit, amount).otherwise(F.lit(0).cast("bigint"))


def scenario_points(inputs: DataFrame, o: fc.ForecastOptions, s: Scenario) -> DataFrame:
    cost = F.lit(s.monthly_cost_minor).cast("bigint")
    cost = scale_minor(cost, BURDEN) if s.burdened else cost
    once = F.when(F.col("day") == s.from_day, F.lit(s.one_off_minor)).otherwise(0).cast("bigint")
    deltas = fc.day_deltas(apply(inputs, s), o).withColumns(
        {
            "committed_delta": F.col("committed_delta") - _on_firsts(cost, s) + once,
            "receivables_delta": F.col("receivables_delta")
            + _on_firsts(F.lit(s.monthly_revenue_minor).cast("bigint"), s),
        }
    )
    return fc.compose(deltas, o).select("org_id", "day", "date", "p10", "p50", "p90")


def compare(inputs: DataFrame, o: fc.ForecastOptions, s: Scenario) -> DataFrame:
    """Base and scenario per tenant: end balance, lowest balance, first day below zero, difference."""

    def outcome(points: DataFrame, prefix: str) -> DataFrame:
        return points.groupBy("org_id").agg(
            F.max_by("p50", "day").alias(f"{prefix}_end_minor"),
            F.min("p50").alias(f"{prefix}_low_minor"),
            F.min(F.when(F.col("p50") < 0, F.col("day"))).alias(f"{prefix}_first_negative_day"),
        )

    base = outcome(fc.compose(fc.day_deltas(inputs, o), o), "base")
    changed = outcome(scenario_points(inputs, o, s), "scenario")
    return base.join(changed, "org_id").withColumn(
        "difference_minor", F.col("scenario_end_minor") - F.col("base_end_minor")
    )


@dataclass(frozen=True)
class Driver:
    """Movements that a scenario adds to every tenant: on one day, and on the first of each month from `from_day`.

    `monthly_minor` holds the amounts of the months in turn; the last goes on.
    """

    name: str
    from_day: int = 1
    once_minor: int = 0
    monthly_minor: tuple[int, ...] = (0,)

    def on(self, o: fc.ForecastOptions) -> list[tuple[int, int]]:
        """(day, amount) within the horizon; months are counted from the first one after `from_day` or on it."""
        moves = [(self.from_day, self.once_minor)] if self.once_minor else []
        firsts = [i for i in range(self.from_day, o.horizon_days + 1) if (o.as_of + dt.timedelta(days=i)).day == 1 and (i > self.from_day or not self.once_minor)]
        return moves + [(i, self.monthly_minor[min(k, len(self.monthly_minor) - 1)]) for k, i in enumerate(firsts)]


def loan(principal_minor: int, yearly_rate: str, months: int, from_day: int) -> Driver:
    """Money paid out on a day and paid back in equal parts, interest included, rounded to the cent."""
    r = Decimal(yearly_rate) / 12
    part = Decimal(principal_minor) / months if r == 0 else Decimal(principal_minor) * r / (1 - (1 + r) ** -months)
    return Driver("loan", from_day, principal_minor, (-int(part.quantize(Decimal(1), ROUND_HALF_UP)),))


def hire_with_ramp(monthly_cost_minor: int, revenue_minor: int, ramp_months: int, from_day: int) -> Driver:
    """A hire at base pay plus burden whose revenue grows in equal steps to its full height."""
    cost = int((Decimal(monthly_cost_minor) * Decimal(BURDEN)).quantize(Decimal(1), ROUND_HALF_UP))
    steps = (int((Decimal(revenue_minor) * k / ramp_months).quantize(Decimal(1), ROUND_HALF_UP)) for k in range(1, ramp_months + 1))
    return Driver("hire", from_day, 0, tuple(s - cost for s in steps))


def customer_change(inputs: DataFrame, shares: DataFrame, o: fc.ForecastOptions, sign: int) -> DataFrame:
    """A dated frame (`org_id, day, delta_minor`): a share of new revenue lost (-1) or won (1). `shares`: `org_id, share`."""
    amount = F.floor(F.col("new_revenue_minor").cast("double") * F.col("share") + 0.5).cast("bigint") * sign
    firsts = [i for i in range(1, o.horizon_days + 1) if (o.as_of + dt.timedelta(days=i)).day == 1]
    rows = inputs.join(shares, "org_id").select("org_id", "collection_lag_days", amount.alias("delta_minor"), F.explode(F.array(*[F.lit(i) for i in firsts])).alias("day"))
    return rows.where(F.col("day") > F.col("collection_lag_days")).select("org_id", "day", "delta_minor")


def compare_drivers(inputs: DataFrame, o: fc.ForecastOptions, driver: Driver | DataFrame) -> DataFrame:
    """Base and scenario per tenant as in `compare`, and the day the scenario breaks even.

    Break-even is the first day from which the scenario is never below the base again within the horizon; null if it never
    was below, or is on the last day.
    """
    base = fc.compose(fc.day_deltas(inputs, o), o).select("org_id", "day", "p50")
    if isinstance(driver, Driver):
        moves = F.array(*[F.struct(F.lit(d).alias("day"), F.lit(m).cast("bigint").alias("delta_minor")) for d, m in driver.on(o)])
        added = inputs.select("org_id", F.explode(moves).alias("m")).select("org_id", "m.*")
    else:
        added = driver
    added = added.groupBy("org_id", "day").agg(F.sum("delta_minor").alias("delta"))
    running = Window.partitionBy("org_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = base.join(added, ["org_id", "day"], "left").withColumn("moved", F.sum(F.coalesce("delta", F.lit(0))).over(running))
    changed = F.col("p50") + F.col("moved")
    below = F.max(F.when(F.col("moved") < 0, F.col("day")))
    return days.groupBy("org_id").agg(
        F.max_by("p50", "day").alias("base_end_minor"),
        F.min("p50").alias("base_low_minor"),
        F.min(F.when(F.col("p50") < 0, F.col("day"))).alias("base_first_negative_day"),
        F.max_by(changed, "day").alias("scenario_end_minor"),
        F.min(changed).alias("scenario_low_minor"),
        F.min(F.when(changed < 0, F.col("day"))).alias("scenario_first_negative_day"),
        F.max_by("moved", "day").alias("difference_minor"),
        F.when(below < o.horizon_days, below + 1).alias("break_even_day"),
    )
