"""The metric catalogue: typed definitions over shared conditional aggregates.

A request for any set of metrics becomes one scan of the ledger and one
aggregation per tenant; only the aggregates the set needs are computed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centavo.functions.money import half_up_mean, minor, percent, round_half_up, signed
from centavo.functions.periods import GRAINS, Period, after_months_before, bucket_start, month_start, shift_months
from centavo.operators.predicates import analytical, in_period, occurred, settled
from centavo.session import written

ENGINE_VERSION = "1"
BURN_MONTHS = 6

NO_REVENUE = "no revenue in the period"
NO_MARGIN = "margin is undefined without revenue"
SHORT_HISTORY = "fewer than two months of settled cash"
NO_LIMIT = "cash positive over the window, no limit"

CLASS_MEASURES = ("revenue", "cogs", "opex", "payroll")


@dataclass(frozen=True)
class MetricDef:
    key: str
    unit: str
    measures: tuple[str, ...]
    value: Callable[[], Column]
    confidence: Callable[[], Column]
    source_count: Callable[[], Column]
    reason: Callable[[], Column] = field(default=lambda: F.lit(None).cast("string"))
    statement: str | None = None


def _sum(name: str) -> Column:
    return F.col(f"{name}_minor")


def _n(name: str) -> Column:
    return F.col(f"{name}_n")


def _opex() -> Column:
    return _sum("opex") + _sum("payroll")


def _known(n: Column) -> Column:
    return F.when(n == 0, "insufficient_data").otherwise("high")


def _burn() -> Column:
    mean = half_up_mean(_sum("burn"), _n("burn"))
    return F.when(_n("burn") >= 2, F.when(mean < 0, -mean).otherwise(F.lit(0).cast("bigint")))


def _burn_confidence() -> Column:
    return F.when(_n("burn") < 2, "insufficient_data").when(_n("burn") < 4, "medium").otherwise("high")


def _burn_reason() -> Column:
    return F.when(_n("burn") < 2, SHORT_HISTORY).when(
        _n("burn") < 4, F.format_string("only %d months of history", _n("burn"))
    )


METRICS: dict[str, MetricDef] = {
    m.key: m
    for m in (
        MetricDef(
            "revenue",
            "currency",
            ("revenue",),
            lambda: _sum("revenue"),
            lambda: _known(_n("revenue")),
            lambda: _n("revenue"),
            lambda: F.when(_n("revenue") == 0, NO_REVENUE),
            statement="revenue",
        ),
        MetricDef(
            "cogs",
            "currency",
            ("cogs",),
            lambda: _sum("cogs"),
            lambda: _known(_n("cogs")),
            lambda: _n("cogs"),
            statement="cogs",
        ),
        MetricDef(
            "gross_margin",
            "percent",
            ("revenue", "cogs"),
            lambda: F.when(_sum("revenue") != 0, percent(_sum("revenue") - _sum("cogs"), _sum("revenue"))),
            lambda: F.when(_sum("revenue") == 0, "insufficient_data")
            .when(_n("revenue") > 0, "high")
            .otherwise("medium"),
            lambda: F.when(_sum("revenue") == 0, 0).otherwise(_n("revenue") + _n("cogs")),
            lambda: F.when(_sum("revenue") == 0, NO_MARGIN),
        ),
        MetricDef(
            "operating_expenses",
            "currency",
            ("opex", "payroll"),
            _opex,
            lambda: _known(_n("opex") + _n("payroll")),
            lambda: _n("opex") + _n("payroll"),
        ),
        MetricDef(
            "net_profit",
            "currency",
            ("revenue", "cogs", "opex", "payroll"),
            lambda: _sum("revenue") - _sum("cogs") - _opex(),
            lambda: _known(_n("revenue")),
            lambda: _n("revenue"),
        ),
        MetricDef(
            "cash_position",
            "currency",
            ("cash",),
            lambda: _sum("cash"),
            lambda: _known(_n("cash")),
            lambda: _n("cash"),
        ),
        MetricDef(
            "monthly_burn",
            "currency",
            ("burn",),
            _burn,
            _burn_confidence,
            lambda: _n("burn"),
            _burn_reason,
        ),
        MetricDef(
            "runway_months",
            "months",
            ("cash", "burn"),
            lambda: F.when(
                _burn() > 0, round_half_up(_sum("cash").cast("double") / _burn().cast("double"), 1)
            ),
            lambda: F.when(_burn() == 0, "high").otherwise(_burn_confidence()),
            lambda: F.lit(0).cast("bigint"),
            lambda: F.when(_n("burn") < 2, SHORT_HISTORY).when(_burn() == 0, NO_LIMIT),
        ),
    )
}


def statement_totals(
    ledger: DataFrame, period: Period, statements: Iterable[str] = CLASS_MEASURES, direction: str | None = None
) -> DataFrame:
    """Sum and row count of each statement class per tenant over a period."""
    names = tuple(statements)
    rows = in_period(analytical(ledger), period).where(F.col("statement").isin(*names))
    if direction is not None:
        rows = rows.where(F.col("direction") == direction)
    amount = minor("amount")
    aggs = []
    for name in names:
        hit = F.col("statement") == name
        aggs.append(F.coalesce(F.sum(F.when(hit, amount)), F.lit(0).cast("bigint")).alias(f"{name}_minor"))
        aggs.append(F.count(F.when(hit, 1)).alias(f"{name}_n"))
    return rows.groupBy("org_id").agg(*aggs)


@dataclass(frozen=True)
class MetricRequest:
    """A set of metrics over one period."""

    period: Period
    keys: tuple[str, ...] = tuple(METRICS)

    @property
    def measures(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(m for k in self.keys for m in METRICS[k].measures))


def measures(ledger: DataFrame, requests: Sequence[MetricRequest]) -> DataFrame:
    """One row per tenant with `r<i>_<name>_minor` and `r<i>_<name>_n` per request and measure.

    Measures are the statement classes, `cash` (settled to the period end) and
    `burn` (net of the trailing months and the number of months seen). All
    requests are answered by one scan; `burn` may be asked for one end date.
    """
    amount = minor("amount")
    flow = signed("direction", amount)
    zero = F.lit(0).cast("bigint")
    hits: dict[str, Column] = {}
    burn_ends = set()
    for i, request in enumerate(requests):
        period = request.period
        for name in request.measures:
            if name == "cash":
                hit = settled(period.end)
            elif name == "burn":
                burn_ends.add(period.end)
                hit = F.col("posted_at").isNotNull() & after_months_before(
                    F.col("posted_at"), period.end, BURN_MONTHS
                )
            else:
                hit = period.contains(F.col("occurred_at")) & (F.col("statement") == name)
            hits[f"r{i}_{name}"] = hit
    if len(burn_ends) > 1:
        raise ValueError("burn may be asked for one end date at a time")
    rows = analytical(ledger).where(reduce(lambda a, b: a | b, hits.values()))
    if not any(n.endswith(("_cash", "_burn")) for n in hits):  # those go by the day of settlement
        rows = occurred(rows, min(r.period.start for r in requests), max(r.period.end for r in requests))

    def value(name: str) -> Column:
        return flow if name.endswith(("_cash", "_burn")) else amount

    sums = [F.coalesce(F.sum(F.when(hit, value(n))), zero).alias(f"{n}_minor") for n, hit in hits.items()]
    burns = [n for n in hits if n.endswith("_burn")]
    counts = [F.count(F.when(hit, 1)).alias(f"{n}_n") for n, hit in hits.items() if n not in burns]
    if not burns:
        return rows.groupBy("org_id").agg(*sums, *counts)
    month = F.when(hits[burns[0]], month_start(F.col("posted_at")))
    by_month = rows.groupBy("org_id", month.alias("burn_month")).agg(*sums, *counts)
    return by_month.groupBy("org_id").agg(
        *[F.sum(f"{n}_minor").alias(f"{n}_minor") for n in hits],
        *[F.sum(f"{n}_n").alias(f"{n}_n") for n in hits if n not in burns],
        *[F.count("burn_month").alias(f"{n}_n") for n in burns],
    )


def with_every_tenant(totals: DataFrame, organizations: DataFrame | None) -> DataFrame:
    """Add tenants that have no rows at all, with zero counts."""
    if organizations is None:
        return totals
    return organizations.select("org_id").join(totals, "org_id", "left").fillna(0)


def metric_batch(
    ledger: DataFrame, requests: Sequence[MetricRequest], organizations: DataFrame | None = None
) -> DataFrame:
    """Long metric table for several periods: one row per tenant, period and metric."""
    totals = with_every_tenant(measures(ledger, requests), organizations)
    names = sorted({m for r in requests for m in r.measures})

    def request_struct(i: int, request: MetricRequest) -> Column:
        fields = [
            F.lit(request.period.start).alias("period_start"),
            F.lit(request.period.end).alias("period_end"),
            F.lit(request.period.grain).alias("grain"),
            F.array(*[F.lit(k) for k in request.keys]).alias("keys"),
        ]
        for name in names:
            for suffix in ("minor", "n"):
                known = name in request.measures
                source = F.col(f"r{i}_{name}_{suffix}") if known else F.lit(0).cast("bigint")
                fields.append(source.alias(f"{name}_{suffix}"))
        return F.struct(*fields)

    per_request = totals.select(
        "org_id", F.explode(F.array(*[request_struct(i, r) for i, r in enumerate(requests)])).alias("r")
    ).select("org_id", "r.*")
    defs = [METRICS[k] for k in METRICS if any(k in r.keys for r in requests)]
    return (
        per_request.select(
            "org_id", "period_start", "period_end", "grain", "keys", F.explode(F.array(*[_metric_struct(d) for d in defs])).alias("m")
        )
        .where(F.array_contains("keys", F.col("m.metric_key")))
        .select(
            "org_id",
            "m.metric_key",
            "period_start",
            "period_end",
            "grain",
            "m.unit",
            "m.value_minor",
            "m.value",
            "m.confidence",
            "m.reason",
            "m.source_count",
            "m.drill_statement",
            F.lit(ENGINE_VERSION).alias("engine_version"),
        )
    )


def metric_table(
    ledger: DataFrame,
    period: Period,
    keys: Iterable[str] | None = None,
    organizations: DataFrame | None = None,
) -> DataFrame:
    """Long metric table of one period, with provenance."""
    wanted = tuple(METRICS if keys is None else keys)
    return metric_batch(ledger, [MetricRequest(period, wanted)], organizations)


def _metric_struct(d: MetricDef) -> Column:
    value = d.value()
    money = d.unit == "currency"
    return F.struct(
        F.lit(d.key).alias("metric_key"),
        F.lit(d.unit).alias("unit"),
        (value if money else F.lit(None)).cast("bigint").alias("value_minor"),
        (F.lit(None) if money else value).cast("double").alias("value"),
        d.confidence().alias("confidence"),
        d.reason().alias("reason"),
        d.source_count().cast("bigint").alias("source_count"),
        F.lit(d.statement).cast("string").alias("drill_statement"),
    )


def metric_comparison(
    ledger: DataFrame, current: Period, prior: Period, statements: Iterable[str] = CLASS_MEASURES
) -> DataFrame:
    """Statement totals of two periods side by side, from one scan."""
    names = tuple(statements)
    amount = minor("amount")
    day = F.col("occurred_at")
    rows = occurred(analytical(ledger), min(current.start, prior.start), max(current.end, prior.end)).where(
        (current.contains(day) | prior.contains(day)) & F.col("statement").isin(*names)
    )
    zero = F.lit(0).cast("bigint")
    aggs = []
    for label, period in (("current", current), ("prior", prior)):
        for name in names:
            hit = period.contains(day) & (F.col("statement") == name)
            aggs.append(F.coalesce(F.sum(F.when(hit, amount)), zero).alias(f"{label}_{name}_minor"))
    return rows.groupBy("org_id").agg(*aggs)


def margin_change(ledger: DataFrame, current: Period, prior: Period) -> DataFrame:
    """Gross margin of two periods, the change in points and its direction."""
    totals = metric_comparison(ledger, current, prior, ("revenue", "cogs"))

    def margin(label: str) -> Column:
        revenue, cost = F.col(f"{label}_revenue_minor"), F.col(f"{label}_cogs_minor")
        return F.when(revenue != 0, percent(revenue - cost, revenue))

    delta = round_half_up(F.col("margin_pct") - F.col("prior_margin_pct"), 2)
    return totals.select(
        "org_id", margin("current").alias("margin_pct"), margin("prior").alias("prior_margin_pct")
    ).select(
        "org_id",
        "margin_pct",
        "prior_margin_pct",
        delta.alias("delta_points"),
        F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "flat").alias("direction"),
    )


def metric_series(ledger: DataFrame, period: Period, grain: str) -> DataFrame:
    """Revenue, cost, operating expense and profit per tenant and calendar bucket."""
    from centavo.functions.periods import bucket_start

    bucket = bucket_start(F.col("occurred_at"), grain)
    rows = in_period(analytical(ledger), period)
    return _series(rows, bucket.alias("bucket_start"), "bucket_start")


def monthly_series(ledger: DataFrame, end, months: int = 24) -> DataFrame:
    """Profit and loss per calendar month over the trailing months; empty months are absent."""
    from centavo.functions.periods import month_key

    rows = occurred(analytical(ledger), shift_months(end, -months) + dt.timedelta(days=1), end)
    return _series(rows, month_key(F.col("occurred_at")).alias("month"), "month")


def _series(rows: DataFrame, bucket: Column, name: str) -> DataFrame:
    amount = minor("amount")
    zero = F.lit(0).cast("bigint")

    def total(*statements: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("statement").isin(*statements), amount)), zero)

    grouped = rows.groupBy("org_id", bucket).agg(
        total("revenue").alias("revenue_minor"),
        total("cogs").alias("cogs_minor"),
        total("opex", "payroll").alias("opex_minor"),
    )
    revenue, cost = F.col("revenue_minor"), F.col("cogs_minor")
    return grouped.select(
        "org_id",
        name,
        "revenue_minor",
        "cogs_minor",
        "opex_minor",
        (revenue - cost - F.col("opex_minor")).alias("profit_minor"),
        F.when(revenue > 0, percent(revenue - cost, revenue)).alias("gross_margin_pct"),
    )


def metric_grains(ledger: DataFrame, period: Period, organizations: DataFrame, grains: Sequence[str] = GRAINS, keys: Iterable[str] | None = None) -> DataFrame:
    """Any metrics in every bucket of every grain over a period: one row per tenant, grain, bucket and metric.

    One scan brings the ledger to one row per tenant and day; all grains roll up from there. Flows add up over a bucket's days
    inside the period. Cash, burn and runway do not add up: a bucket has the value of its last day, cash as a running total
    and burn over the trailing months to that day. Windows run over calendar days of a tenant, never over its rows.
    """
    wanted = [METRICS[k] for k in (METRICS if keys is None else keys)]
    daily = written(_daily(ledger), "metric-days")
    first, last = F.lit(period.start), F.lit(period.end)
    day = F.explode(F.sequence(first, last)).alias("day")
    spine = organizations.select("org_id").distinct().withColumn("grain", F.explode(F.array(*[F.lit(g) for g in grains]))).select("org_id", "grain", day)
    start = F.when(F.lit(False), F.col("day"))
    for grain in grains:
        start = F.when(F.col("grain") == grain, bucket_start(F.col("day"), grain)).otherwise(start)
    days = spine.withColumn("bucket_start", start)
    flows = [f"{m}_{s}" for m in CLASS_MEASURES for s in ("minor", "n")]
    inside = daily.where(F.col("day").between(first, last)).select("org_id", "day", *flows)
    zero = F.lit(0).cast("bigint")
    buckets = days.join(inside, ["org_id", "day"], "left").groupBy("org_id", "grain", "bucket_start").agg(
        F.max("day").alias("bucket_end"), *[F.coalesce(F.sum(c), zero).alias(c) for c in flows]
    )
    ends = buckets.select("org_id", F.col("bucket_end").alias("end")).distinct()
    held = buckets.join(_to_day(daily, ends).withColumnRenamed("end", "bucket_end"), ["org_id", "bucket_end"])
    return held.select("org_id", "grain", "bucket_start", "bucket_end", F.explode(F.array(*[_metric_struct(d) for d in wanted])).alias("m")).select(
        "org_id", "grain", "bucket_start", "bucket_end", "m.*"
    )


def _daily(ledger: DataFrame) -> DataFrame:
    """Per tenant and day: sum and count of each class by the day a row occurred, cash by the day it was settled."""
    amount = minor("amount")
    by_day = F.array(
        F.struct(F.col("occurred_at").alias("day"), F.col("statement").alias("kind"), amount.alias("x")),
        F.struct(F.col("posted_at").alias("day"), F.lit("cash").alias("kind"), signed("direction", amount).alias("x")),
    )
    rows = analytical(ledger).select("org_id", F.explode(by_day).alias("e")).select("org_id", "e.*").where("day IS NOT NULL")
    rows = rows.where(F.col("kind").isin("cash", *CLASS_MEASURES))
    zero = F.lit(0).cast("bigint")
    aggs = []
    for name in (*CLASS_MEASURES, "cash"):
        hit = F.col("kind") == name
        aggs += [F.coalesce(F.sum(F.when(hit, F.col("x"))), zero).alias(f"{name}_minor"), F.count_if(hit).alias(f"{name}_n")]
    return rows.groupBy("org_id", "day").agg(*aggs)


def _to_day(daily: DataFrame, ends: DataFrame) -> DataFrame:
    """Cash settled up to each (tenant, end), and its burn: net and number of months seen in the trailing months."""
    cash = daily.where("cash_n > 0").select("org_id", "day", "cash_minor", "cash_n")
    before = F.add_months("end", -BURN_MONTHS).alias("day")
    marks = ends.select("org_id", F.col("end").alias("day")).unionByName(ends.select("org_id", before)).distinct()
    laid = cash.join(marks.withColumn("asked", F.lit(True)), ["org_id", "day"], "full_outer")
    upto = Window.partitionBy("org_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("bigint")
    running = laid.select("org_id", "day", "asked", *[F.coalesce(F.sum(c).over(upto), zero).alias(c) for c in ("cash_minor", "cash_n")]).where("asked").drop("asked")
    now = running.select("org_id", F.col("day").alias("end"), "cash_minor", "cash_n")
    then = running.select("org_id", F.col("day").alias("low"), F.col("cash_minor").alias("low_minor"))
    # a month is seen if it has a settled day in the window: its last lies after the window's begin, its first not after its end
    months = cash.groupBy("org_id", month_start(F.col("day")).alias("month")).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    low = F.add_months("end", -BURN_MONTHS)
    asked = ends.withColumn("low", low).withColumn("month", F.explode(F.sequence(month_start(F.col("low")), month_start(F.col("end")), F.make_ym_interval(months=F.lit(1)))))
    seen = (
        asked.join(months, ["org_id", "month"])
        .where((F.col("last_day") > F.col("low")) & (F.col("first_day") <= F.col("end")))
        .groupBy("org_id", "end")
        .agg(F.count("*").alias("burn_n"))
    )
    out = now.withColumn("low", low).join(ends, ["org_id", "end"], "left_semi").join(then, ["org_id", "low"])
    return out.join(seen, ["org_id", "end"], "left").select(
        "org_id", "end", "cash_minor", "cash_n", (F.col("cash_minor") - F.col("low_minor")).alias("burn_minor"), F.coalesce("burn_n", zero).alias("burn_n")
    )
