"""Thirteen-week cash forecast for every tenant in one job.

The ledger and the invoices are each reduced to one row per tenant holding
bounded arrays (pay dates of four months, days of the month, days of the
horizon). Everything after that is a narrow computation per tenant: the day
spine is exploded, running totals are a window over its 91 rows, and risks are
read from the same rows. No step collects an unbounded group.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centavo.functions.money import format_usd, half_up_mean, minor, round_half_up, signed
from centavo.functions.periods import after_days_before, after_months_before
from centavo.operators.behavior import MIN_SAMPLES, fit_behavior
from centavo.operators.predicates import OPEN_STATES, live, open_documents, settled
from centavo.operators.versions import top_per

METHOD_VERSION = "1"


@dataclass(frozen=True)
class ForecastOptions:
    """Fixed model values; the defaults are the published method."""

    as_of: dt.date
    horizon_days: int = 91
    payroll_months: int = 4
    vendor_months: int = 4
    vendor_min_rows: int = 3
    variable_days: int = 90
    revenue_months: int = 6
    revenue_factor: str = "0.8"
    default_days_late: int = 14
    collection_days: int = 30
    overdue_delay_days: int = 5
    cadence_days: tuple[int, int] = (5, 40)
    recent_payrolls: int = 6
    spread_per_day: int = 18_000
    spread_sigma: float = 2.6
    upside: float = 0.85
    runway_percent: int = 35
    late_invoices: int = 3
    pre_run: bool = False
    payroll_categories: tuple[str, ...] | None = None


def history_confidence(days: Column) -> Column:
    return F.when(days < 90, "low").when(days < 365, "medium").otherwise("high")


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def ledger_activity(ledger: DataFrame, o: ForecastOptions) -> DataFrame:
    """Sums per tenant, pay date and vendor from one scan of the ledger."""
    occurred = F.col("occurred_at")
    amount = minor("amount")
    own = ~F.col("is_transfer")
    cash = own & settled(o.as_of)
    payroll = (F.col("statement") == "payroll") & after_months_before(occurred, o.as_of, o.payroll_months)
    if o.payroll_categories is not None:
        payroll = payroll & F.col("category").isin(*o.payroll_categories)
    cost = own & (F.col("direction") == "outflow") & F.col("statement").isin("opex", "cogs")
    vendor = cost & F.col("merchant_name").isNotNull() & after_months_before(occurred, o.as_of, o.vendor_months)
    variable = cost & F.col("merchant_name").isNull() & after_days_before(occurred, o.as_of, o.variable_days)
    day = F.dayofmonth(occurred).cast("bigint")
    return (
        live(ledger)
        .groupBy(
            "org_id",
            F.when(payroll, occurred).alias("pay_date"),
            F.when(vendor, F.col("merchant_name")).alias("vendor"),
        )
        .agg(
            F.sum(F.when(cash, signed("direction", amount))).alias("cash_minor"),
            F.min(occurred).alias("first_day"),
            F.max(occurred).alias("last_day"),
            F.sum(F.when(payroll, amount)).alias("payroll_minor"),
            F.sum(F.when(vendor, amount)).alias("vendor_minor"),
            F.sum(F.when(vendor, day)).alias("vendor_days"),
            F.count(F.when(vendor, 1)).alias("vendor_n"),
            F.sum(F.when(variable, amount)).alias("variable_minor"),
        )
    )


def recurring_vendors(activity: DataFrame, o: ForecastOptions) -> DataFrame:
    """Vendors paid often enough: mean amount per payment and usual day of month."""
    return activity.where(F.col("vendor").isNotNull() & (F.col("vendor_n") >= o.vendor_min_rows)).select(
        "org_id",
        "vendor",
        half_up_mean(F.col("vendor_minor"), F.col("vendor_n")).alias("typical_minor"),
        half_up_mean(F.col("vendor_days"), F.col("vendor_n")).alias("day_of_month"),
        F.col("vendor_n").alias("n"),
    )


def ledger_inputs(ledger: DataFrame, o: ForecastOptions) -> DataFrame:
    """One row per tenant: cash, history, pay dates (at most one per day) and vendor days (at most 31)."""
    recurring = F.col("vendor").isNotNull() & (F.col("vendor_n") >= o.vendor_min_rows)
    n = F.col("vendor_n")
    slots = (
        ledger_activity(ledger, o)
        .groupBy(
            "org_id",
            "pay_date",
            F.when(recurring, half_up_mean(F.col("vendor_days"), n)).cast("int").alias("dom"),
        )
        .agg(
            F.sum("cash_minor").alias("cash_minor"),
            F.min("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"),
            F.sum("payroll_minor").alias("payroll_minor"),
            F.sum(F.when(recurring, half_up_mean(F.col("vendor_minor"), n))).alias("vendor_minor"),
            F.sum("variable_minor").alias("variable_minor"),
        )
    )
    return slots.groupBy("org_id").agg(
        F.coalesce(F.sum("cash_minor"), _zero()).alias("starting_cash_minor"),
        F.datediff(F.max("last_day"), F.min("first_day")).alias("history_days"),
        F.array_sort(
            F.collect_list(F.when(F.col("pay_date").isNotNull(), F.struct("pay_date", "payroll_minor")))
        ).alias("payrolls"),
        F.collect_list(F.when(F.col("dom").isNotNull(), F.struct("dom", "vendor_minor"))).alias("vendor_days"),
        half_up_mean(F.coalesce(F.sum("variable_minor"), _zero()), o.variable_days).alias("daily_variable_minor"),
    )


def days_late(o: ForecastOptions) -> Column:
    known = F.col("sample_count") >= MIN_SAMPLES
    return F.when(known, F.floor(F.col("mean_days_late") + F.lit(0.5)).cast("int")).otherwise(
        F.lit(o.default_days_late)
    )


def expected_day(o: ForecastOptions) -> Column:
    """Days after `as_of` on which a receivable is expected; money already late lands soon."""
    due = F.coalesce(F.col("due_date"), F.lit(o.as_of))
    ahead = F.datediff(F.date_add(due, days_late(o)), F.lit(o.as_of))
    return F.when(ahead <= 0, F.lit(o.overdue_delay_days)).otherwise(ahead)


def _timed(rows: DataFrame, behavior: DataFrame, o: ForecastOptions) -> DataFrame:
    fitted = behavior.select("org_id", "customer_id", "mean_days_late", "sample_count")
    return rows.join(fitted, ["org_id", "customer_id"], "left").select(
        *[c for c in rows.columns],
        expected_day(o).alias("day"),
        F.coalesce(F.col("sample_count") >= MIN_SAMPLES, F.lit(False)).alias("confident"),
    )


def receivable_timing(invoices: DataFrame, behavior: DataFrame, o: ForecastOptions) -> DataFrame:
    """Open balances per tenant and expected date.

    Balances are summed per customer and due date before the join with
    behaviour, so one very large customer is a bounded number of rows there.
    """
    owed = (
        open_documents(invoices, positive_only=True)
        .groupBy("org_id", "customer_id", "due_date")
        .agg(F.sum(minor("balance")).alias("balance_minor"), F.count("*").alias("n"))
    )
    return (
        _timed(owed, behavior, o)
        .groupBy("org_id", "day")
        .agg(
            F.sum("balance_minor").alias("balance_minor"),
            F.sum("n").alias("n"),
            F.bool_or("confident").alias("confident"),
        )
        .withColumn("expected_on", F.date_add(F.lit(o.as_of), F.col("day")))
    )


def invoice_inputs(invoices: DataFrame, o: ForecastOptions) -> DataFrame:
    """One row per tenant from one scan of the invoices: receivables per day and new revenue.

    Rows are summed per customer and due date. The customer's mean lateness is
    then a window over those sums, a bounded number per customer, so behaviour
    needs no join of its own.
    """
    owed = F.col("status").isin(*OPEN_STATES) & (F.col("balance") > 0)
    both = F.col("paid_on").isNotNull() & F.col("due_date").isNotNull()
    lag = F.datediff("paid_on", "due_date").cast("bigint")
    fitted = both & (F.col("status") == "paid") & F.col("customer_id").isNotNull()
    recent = after_months_before(F.col("issued_on"), o.as_of, o.revenue_months)
    due = F.coalesce(F.col("due_date"), F.lit(o.as_of))
    sums = invoices.groupBy("org_id", "customer_id", F.when(owed, due).alias("due_date")).agg(
        F.sum(F.when(owed, minor("balance"))).alias("balance_minor"),
        F.count(F.when(fitted, 1)).alias("lag_n"),
        F.sum(F.when(fitted, lag)).alias("lag_sum"),
        F.sum(F.when(recent, minor("total"))).alias("issued_minor"),
        F.sum(F.when(recent & both, lag)).alias("recent_lag_sum"),
        F.count(F.when(recent & both, 1)).alias("recent_lag_n"),
    )
    customer = Window.partitionBy("org_id", "customer_id")
    n, total = F.sum("lag_n").over(customer), F.sum("lag_sum").over(customer)
    timed = sums.withColumns(
        {
            "sample_count": n,
            "mean_days_late": round_half_up(total.cast("double") / F.when(n > 0, n.cast("double")), 2),
        }
    )
    open_row = F.col("due_date").isNotNull()
    day = F.when(open_row, expected_day(o))
    by_day = (
        timed.withColumns({"day": day, "confident": open_row & (F.col("sample_count") >= MIN_SAMPLES)})
        .groupBy("org_id", F.when(F.col("day") <= o.horizon_days, F.col("day")).alias("day"))
        .agg(
            F.sum("balance_minor").alias("balance_minor"),
            F.bool_or("confident").alias("confident"),
            *[F.sum(c).alias(c) for c in ("issued_minor", "recent_lag_sum", "recent_lag_n")],
        )
    )
    return by_day.groupBy("org_id").agg(
        F.collect_list(F.when(F.col("day").isNotNull(), F.struct("day", "balance_minor"))).alias("receivables"),
        F.bool_or("confident").alias("timing_from_history"),
        *_run_rate(F.sum("issued_minor"), F.sum("recent_lag_sum"), F.sum("recent_lag_n"), o),
    )


def _run_rate(issued: Column, lag_sum: Column, lag_n: Column, o: ForecastOptions) -> list[Column]:
    rate = Fraction(o.revenue_factor) / o.revenue_months
    mean_lag = F.coalesce(half_up_mean(lag_sum, lag_n), F.lit(o.default_days_late))
    return [
        half_up_mean(issued * rate.numerator, rate.denominator).alias("new_revenue_minor"),
        (mean_lag + o.collection_days).cast("int").alias("collection_lag_days"),
    ]


def new_revenue(invoices: DataFrame, o: ForecastOptions) -> DataFrame:
    """Discounted monthly invoicing run rate and the day from which it is collected."""
    lag = F.when(
        F.col("paid_on").isNotNull() & F.col("due_date").isNotNull(),
        F.datediff("paid_on", "due_date").cast("bigint"),
    )
    return (
        invoices.where(after_months_before(F.col("issued_on"), o.as_of, o.revenue_months))
        .groupBy("org_id")
        .agg(*_run_rate(F.sum(minor("total")), F.sum(lag), F.count(lag), o))
    )


def late_candidates(invoices: DataFrame, customers: DataFrame, behavior: DataFrame, o: ForecastOptions) -> DataFrame:
    """One row per tenant: for each expected day the largest open invoices.

    Only the largest few of any day can be among the largest few after a pay
    date. The rank is limited per customer and due date before the join with
    behaviour and per day after it; days past the horizon share one bucket.
    """
    n = o.late_invoices
    slim = open_documents(invoices, positive_only=True).select(
        "org_id", "customer_id", "due_date", "invoice_id", minor("balance").alias("balance_minor")
    )
    order = [F.col("balance_minor").desc(), F.col("invoice_id")]
    first = top_per(slim, ["org_id", "customer_id", "due_date"], order, n).drop("rank")
    timed = _timed(first, behavior, o).withColumn("day", F.least("day", F.lit(o.horizon_days + 1)))
    kept = top_per(timed, ["org_id", "day"], order, n)
    named = kept.join(customers.select("org_id", "customer_id", "name"), ["org_id", "customer_id"], "left")
    entry = F.struct(
        (-F.col("balance_minor")).alias("neg_balance"),
        F.col("invoice_id"),
        F.col("day"),
        F.coalesce("name", F.lit("Unknown")).alias("customer"),
    )
    return named.groupBy("org_id").agg(F.array_sort(F.collect_list(entry)).alias("late"))


def forecast_inputs(
    ledger: DataFrame,
    invoices: DataFrame,
    organizations: DataFrame,
    o: ForecastOptions,
    customers: DataFrame | None = None,
) -> DataFrame:
    """Everything the projection needs, one row per tenant.

    With `customers` the late-invoice candidates used by the risk rules are added.
    """
    out = (
        organizations.select("org_id")
        .join(ledger_inputs(ledger, o), "org_id", "left")
        .join(invoice_inputs(invoices, o), "org_id", "left")
    )
    if customers is not None:
        late = late_candidates(invoices, customers, fit_behavior(invoices), o)
        out = out.join(late, "org_id", "left")
    return out.withColumns(
        {
            "starting_cash_minor": F.coalesce("starting_cash_minor", _zero()),
            "history_days": F.coalesce("history_days", F.lit(0)),
            "daily_variable_minor": F.coalesce("daily_variable_minor", _zero()),
            "new_revenue_minor": F.coalesce("new_revenue_minor", _zero()),
            "collection_lag_days": F.coalesce(
                "collection_lag_days", F.lit(o.default_days_late + o.collection_days)
            ),
            "timing_from_history": F.coalesce("timing_from_history", F.lit(False)),
        }
    ).transform(lambda df: with_payroll_projection(df, o))


def with_payroll_projection(inputs: DataFrame, o: ForecastOptions) -> DataFrame:
    """Add cadence (upper median gap), typical amount and the projected pay days."""
    runs = F.col("payrolls")
    n = F.size(runs)
    gaps = F.array_sort(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.datediff(F.get(runs, i)["pay_date"], F.get(runs, i - 1)["pay_date"]),
        )
    )
    low, high = o.cadence_days
    median = F.get(gaps, F.floor(F.size(gaps) / 2).cast("int"))
    recent = F.slice(runs, F.greatest(F.lit(1), n - (o.recent_payrolls - 1)), F.lit(o.recent_payrolls))
    total = F.aggregate(recent, _zero(), lambda acc, r: acc + r["payroll_minor"])
    since_last = F.datediff(F.lit(o.as_of), F.get(runs, n - 1)["pay_date"])
    steps = F.floor((F.lit(o.horizon_days) + since_last) / F.col("cadence_days")).cast("int")
    days = F.filter(
        F.transform(F.sequence(F.lit(1), steps), lambda k: k * F.col("cadence_days") - since_last),
        lambda d: d > 0,
    )
    return (
        inputs.withColumn("median_gap", F.when(n >= 2, median))
        .withColumn("cadence_days", F.when(F.col("median_gap").between(low, high), F.col("median_gap")))
        .withColumn(
            "typical_payroll_minor",
            F.when(F.col("cadence_days").isNotNull(), half_up_mean(total, F.size(recent).cast("bigint"))),
        )
        .withColumn(
            "pay_days",
            F.when(F.col("cadence_days").isNotNull() & (steps >= 1), days).otherwise(
                F.array().cast("array<int>")
            ),
        )
        .drop("median_gap")
    )


def projected_payroll(inputs: DataFrame, o: ForecastOptions) -> DataFrame:
    """One row per tenant and projected pay date."""
    return inputs.select(
        "org_id", "cadence_days", "typical_payroll_minor", F.explode("pay_days").alias("day")
    ).select(
        "org_id",
        F.date_add(F.lit(o.as_of), F.col("day")).alias("pay_date"),
        F.col("typical_payroll_minor").alias("amount_minor"),
        "cadence_days",
    )


def _sum_where(array: str, key: str, value: str, wanted: Column) -> Column:
    hits = F.filter(F.col(array), lambda e: e[key] == wanted)
    return F.coalesce(F.aggregate(hits, _zero(), lambda acc, e: acc + e[value]), _zero())


def day_deltas(inputs: DataFrame, o: ForecastOptions) -> DataFrame:
    """One row per tenant and day of the horizon with the movement of each stream."""
    spine = inputs.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(o.horizon_days)))).withColumn(
        "date", F.date_add(F.lit(o.as_of), F.col("day"))
    )
    dom = F.dayofmonth("date")
    pays = F.array_contains("pay_days", F.col("day"))
    collects = (dom == 1) & (F.col("day") > F.col("collection_lag_days"))
    return spine.withColumns(
        {
            "run_minor": F.when(pays, F.col("typical_payroll_minor")),
            "vendor_minor": _sum_where("vendor_days", "dom", "vendor_minor", dom),
            "collected_minor": _sum_where("receivables", "day", "balance_minor", F.col("day"))
            + F.when(collects, F.col("new_revenue_minor")).otherwise(_zero()),
        }
    ).withColumns(
        {
            "committed_delta": -F.coalesce("run_minor", _zero()) - F.col("vendor_minor"),
            "receivables_delta": F.col("collected_minor"),
            "variable_delta": -F.col("daily_variable_minor"),
        }
    )


def compose(deltas: DataFrame, o: ForecastOptions) -> DataFrame:
    """Running totals and the band, from daily movements."""
    running = Window.partitionBy("org_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    day = F.col("day").cast("double")
    noise = F.abs("daily_variable_minor").cast("double")
    spread = F.floor(F.sqrt(day) * noise * F.lit(o.spread_sigma) + day * F.lit(float(o.spread_per_day)) + F.lit(0.5))
    upside = F.floor(F.col("spread").cast("double") * F.lit(o.upside) + F.lit(0.5)).cast("bigint")
    totals = deltas.withColumns(
        {
            "committed": F.sum("committed_delta").over(running),
            "receivables_total": F.sum("receivables_delta").over(running),
            "variable": F.sum("variable_delta").over(running),
            "spread": spread.cast("bigint"),
        }
    )
    p50 = F.col("starting_cash_minor") + F.col("committed") + F.col("receivables_total") + F.col("variable")
    return totals.withColumn("p50", p50).withColumns(
        {"p10": F.col("p50") - F.col("spread"), "p90": F.col("p50") + upside}
    )


def forecast_points(inputs: DataFrame, o: ForecastOptions) -> DataFrame:
    return compose(day_deltas(inputs, o), o).select(
        "org_id",
        "date",
        "p10",
        "p50",
        "p90",
        "committed",
        F.col("receivables_total").alias("receivables"),
        "variable",
    )


def _action(text: Column, impact: Column, kind: str) -> Column:
    return F.struct(
        text.alias("text"), impact.cast("bigint").alias("impact_minor"), F.lit(kind).alias("type")
    )


def _risk(kind: str, severity: Column, date: Column, headline: Column, shortfall: Column, days: Column, drivers: Column, actions: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        severity.alias("severity"),
        date.alias("date"),
        headline.alias("headline"),
        shortfall.cast("bigint").alias("shortfall_minor"),
        days.cast("int").alias("days_away"),
        drivers.alias("drivers"),
        actions.alias("actions"),
    )


def forecast_risks(inputs: DataFrame, o: ForecastOptions) -> DataFrame:
    """Named risk events per tenant, from inputs that hold the late-invoice candidates."""
    points = compose(day_deltas(inputs, o), o)
    available = F.col("p50") + F.col("run_minor") if o.pre_run else F.col("p50")
    short = F.col("run_minor").isNotNull() & (available < F.col("run_minor"))
    per_org = points.groupBy("org_id").agg(
        F.array_sort(
            F.collect_list(
                F.when(
                    short,
                    F.struct("day", "date", (F.col("run_minor") - available).alias("shortfall")),
                )
            )
        ).alias("short_runs"),
        F.min(F.when(F.col("p50") < 0, F.struct("day", "date", "p50"))).alias("first_negative"),
        F.max(F.struct("day", "date", "p50")).alias("last"),
        F.first("starting_cash_minor").alias("start"),
        F.first("late").alias("late"),
    )

    def late_after(run: Column) -> Column:
        after = F.filter(F.coalesce("late", F.array()), lambda e: e["day"] > run["day"])
        return F.slice(after, 1, o.late_invoices)

    def payroll_risk(run: Column) -> Column:
        late = late_after(run)
        collectable = -F.aggregate(late, _zero(), lambda acc, e: acc + e["neg_balance"])
        count = F.size(late).cast("string")
        names = F.array_join(F.transform(late, lambda e: e["customer"]), ", ")
        base_actions = F.array(
            _action(F.lit("Hold optional spending until the pay date has passed"), _zero(), "reduce"),
            _action(F.lit("Use a credit line for the gap"), run["shortfall"], "finance"),
        )
        collect = F.array(_action(F.concat(F.lit("Collect "), count, F.lit(" open invoices: "), names), collectable, "collect"))
        day = run["day"]
        return _risk(
            "payroll_shortfall",
            F.when(day <= 7, "critical").when(day <= 21, "high").otherwise("medium"),
            run["date"],
            F.concat(F.lit("Payroll on "), run["date"].cast("string"), F.lit(" is short by "), format_usd(run["shortfall"])),
            run["shortfall"],
            day,
            F.array(
                F.when(
                    F.size(late) > 0,
                    F.concat(count, F.lit(" invoices worth "), format_usd(collectable), F.lit(" are expected later")),
                ).otherwise(F.lit("planned outflow is above the cash on hand that day"))
            ),
            F.when(collectable > 0, F.concat(collect, base_actions)).otherwise(base_actions),
        )

    first = F.col("first_negative")
    cash_risk = _risk(
        "cash_shortfall",
        F.when(first["day"] <= 30, "critical").otherwise("high"),
        first["date"],
        F.concat(F.lit("Cash falls below zero on "), first["date"].cast("string")),
        -first["p50"],
        first["day"],
        F.array(F.lit("committed outflow is above expected collections")),
        F.array(_action(F.lit("Compare a mix of measures"), _zero(), "defer_decision")),
    )
    last, start = F.col("last"), F.col("start")
    fall = F.when(start > 0, F.floor((1 - last["p50"].cast("double") / start.cast("double")) * 100 + 0.5).cast("int"))
    runway_risk = _risk(
        "runway_threshold",
        F.lit("medium"),
        last["date"],
        F.concat(F.lit("Cash falls by "), fall.cast("string"), F.lit("% over the horizon")),
        start - last["p50"],
        last["day"],
        F.array(F.lit("net outflow continues through the horizon")),
        F.array(_action(F.lit("Review the largest expense categories"), _zero(), "reduce")),
    )
    thin = (start > 0) & (last["p50"] * 100 < start * o.runway_percent) & first.isNull()
    return (
        per_org.withColumn("payroll_risks", F.transform("short_runs", payroll_risk))
        .withColumn("cash_risks", F.when(first.isNotNull(), F.array(cash_risk)).otherwise(F.array()))
        .withColumn("runway_risks", F.when(thin, F.array(runway_risk)).otherwise(F.array()))
        .select("org_id", F.explode(F.concat("payroll_risks", "cash_risks", "runway_risks")).alias("r"))
        .select("org_id", "r.*")
    )


def forecast_assumptions(inputs: DataFrame) -> DataFrame:
    """What the projection took for granted, three rows per tenant."""

    def row(key: str, value: Column, source: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.alias("value"), source.alias("source"))

    known = F.col("timing_from_history")
    rows = F.array(
        row(
            "ar_timing_from_history",
            F.when(known, "per-customer history").otherwise("14 days late (prior)"),
            F.when(known, "org_history").otherwise("industry_prior"),
        ),
        row(
            "payroll_cadence",
            F.when(F.size("pay_days") > 0, "projected from history").otherwise("none detected"),
            F.lit("org_history"),
        ),
        row("new_revenue", F.concat(format_usd("new_revenue_minor"), F.lit("/mo")), F.lit("org_history")),
    )
    return inputs.select("org_id", F.explode(rows).alias("a")).select("org_id", "a.*")


def forecast_summary(inputs: DataFrame, o: ForecastOptions) -> DataFrame:
    """Header of each forecast."""
    return inputs.select(
        "org_id",
        F.lit(o.as_of).alias("as_of"),
        F.lit(o.horizon_days).alias("horizon_days"),
        "starting_cash_minor",
        "history_days",
        history_confidence(F.col("history_days")).alias("confidence"),
        F.lit(METHOD_VERSION).alias("method_version"),
    )


def forecast_snapshot(inputs: DataFrame, o: ForecastOptions) -> DataFrame:
    """One row per tenant with points, risks and assumptions as arrays, for the snapshot sink."""
    points = forecast_points(inputs, o)
    risks = forecast_risks(inputs, o)
    assumptions = forecast_assumptions(inputs)

    def packed(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c != "org_id"]
        return df.groupBy("org_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    return (
        forecast_summary(inputs, o)
        .join(packed(points, "points"), "org_id")
        .join(packed(risks.select("org_id", "days_away", "kind", "severity", "date", "shortfall_minor", "drivers"), "risk_events"), "org_id", "left")
        .join(packed(assumptions, "assumptions"), "org_id")
    )
