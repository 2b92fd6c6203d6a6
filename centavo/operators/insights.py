"""Second-tier analyses over the canonical books."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centavo.functions.money import half_up_mean, minor, round_half_up, share, signed
from centavo.functions.periods import Period, after_days_before, after_months_before, month_start, previous, prior_year
from centavo.operators import metrics
from centavo.operators.predicates import EXPENSE_STATEMENTS, analytical, open_documents, settled
from centavo.operators.versions import latest_by

# Upper end in days of each cadence class; longer gaps are not a series.
CADENCES = (("weekly", 9), ("biweekly", 14), ("semimonthly", 20), ("monthly", 45), ("quarterly", 135), ("annual", 400))


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _stddev(n: Column, s1: Column, s2: Column) -> Column:
    """Population deviation from moments; each product is taken as a double."""
    n, s1, s2 = n.cast("double"), s1.cast("double"), s2.cast("double")
    return F.sqrt(F.greatest(n * s2 - s1 * s1, F.lit(0.0))) / n


def recurring_series(ledger: DataFrame, as_of: dt.date, months: int = 12, min_dates: int = 3) -> DataFrame:
    """Vendors paid at a steady rhythm: cadence, typical amount, spread, next date, yearly trend.

    Payments are summed per day first, so a vendor is at most one row per day
    in the windows that follow.
    """
    days = (
        analytical(ledger)
        .where(
            F.col("merchant_name").isNotNull()
            & (F.col("direction") == "outflow")
            & F.col("statement").isin("opex", "cogs")
            & after_months_before(F.col("occurred_at"), as_of, months)
        )
        .groupBy("org_id", F.col("merchant_name").alias("vendor"), F.col("occurred_at").alias("day"))
        .agg(F.sum(minor("amount")).alias("y"))
    )
    per = Window.partitionBy("org_id", "vendor").orderBy("day")
    x = F.datediff(F.col("day"), F.lit(as_of)).cast("bigint")
    rows = days.withColumn("gap", F.datediff(F.col("day"), F.lag("day").over(per))).withColumn("x", x)
    sums = (
        rows.groupBy("org_id", "vendor")
        .agg(
            F.count("*").alias("n"),
            F.max("day").alias("last_day"),
            F.percentile("gap", F.lit(0.5)).alias("gap"),
            F.sum("y").alias("sy"),
            F.sum(F.col("y").cast("decimal(19,0)") * F.col("y").cast("decimal(19,0)")).alias("syy"),
            F.sum("x").alias("sx"),
            F.sum(F.col("x") * F.col("x")).alias("sxx"),
            F.sum(F.col("x") * F.col("y")).alias("sxy"),
        )
        .where(F.col("n") >= min_dates)
    )
    cadence = None
    for name, limit in CADENCES:
        test = F.col("gap") <= limit
        cadence = F.when(test, name) if cadence is None else cadence.when(test, name)
    n, sx, sy = (F.col(c).cast("double") for c in ("n", "sx", "sy"))
    spread = n * F.col("sxx").cast("double") - sx * sx
    slope = F.try_divide(n * F.col("sxy").cast("double") - sx * sy, spread)
    return sums.withColumn("cadence", cadence).where(F.col("cadence").isNotNull()).select(
        "org_id",
        "vendor",
        "cadence",
        half_up_mean(F.col("sy"), F.col("n")).alias("typical_minor"),
        F.floor(_stddev(F.col("n"), F.col("sy"), F.col("syy")) + F.lit(0.5)).alias("stddev_minor"),
        F.date_add("last_day", F.floor(F.col("gap") + F.lit(0.5)).cast("int")).alias("next_expected_on"),
        round_half_up(F.try_divide(slope * F.lit(365.0), sy / n) * F.lit(100.0), 2).alias("trend_pct_per_year"),
        "n",
    )


def working_capital(ledger: DataFrame, invoices: DataFrame, organizations: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    """Days sales outstanding (open receivables over recent revenue) and unpaid bills."""
    owed = open_documents(invoices).groupBy("org_id").agg(F.sum(minor("balance")).alias("open_minor"))
    occurred = F.col("occurred_at")
    sold = (F.col("statement") == "revenue") & after_days_before(occurred, as_of, days)
    unpaid = (F.col("source_record_type") == "Bill") & F.col("posted_at").isNull() & (occurred <= F.lit(as_of))
    sums = (
        analytical(ledger)
        .where(sold | unpaid)
        .groupBy("org_id")
        .agg(
            F.coalesce(F.sum(F.when(sold, minor("amount"))), _zero()).alias("revenue_minor"),
            F.coalesce(F.sum(F.when(unpaid, minor("amount"))), _zero()).alias("payable_minor"),
            F.count(F.when(unpaid, 1)).alias("payable_n"),
        )
    )
    out = organizations.select("org_id").join(owed, "org_id", "left").join(sums, "org_id", "left").fillna(0)
    ratio = F.col("open_minor").cast("double") / F.col("revenue_minor").cast("double") * F.lit(float(days))
    return out.withColumn("dso_days", F.when(F.col("revenue_minor") > 0, round_half_up(ratio, 1)))


def customer_profitability(invoices: DataFrame, costs: DataFrame) -> DataFrame:
    """Revenue less cost attributed through a project reference, per customer.

    `costs`: `project_ref, cost_minor`, one row per project. A customer none of
    whose invoices has costs is reported as insufficient data.
    """
    rows = invoices.select(
        "org_id", "customer_id", F.col("invoice_id").cast("string").alias("project_ref"), minor("total").alias("total_minor")
    ).join(costs, "project_ref", "left")
    grouped = rows.groupBy("org_id", "customer_id").agg(
        F.sum("total_minor").alias("revenue_minor"),
        F.coalesce(F.sum("cost_minor"), _zero()).alias("cost_minor"),
        F.count("cost_minor").alias("costed_n"),
    )
    known = F.col("costed_n") > 0
    return grouped.select(
        "org_id",
        "customer_id",
        "revenue_minor",
        F.when(known, F.col("revenue_minor") - F.col("cost_minor")).alias("profit_minor"),
        F.when(known, "high").otherwise("insufficient_data").alias("confidence"),
    )


def project_costs(ledger: DataFrame) -> DataFrame:
    """Cost of goods per project; the project is the document part of the source key."""
    ref = F.split(F.col("source_txn_id"), ":")[0]
    return (
        analytical(ledger)
        .where((F.col("statement") == "cogs") & (F.col("direction") == "outflow"))
        .groupBy(ref.alias("project_ref"))
        .agg(F.sum(minor("amount")).alias("cost_minor"))
    )


def daily_balances(ledger: DataFrame, as_of: dt.date, account: str = "source_record_type") -> DataFrame:
    """Closing balance per tenant, account and day, days without movement included."""
    moves = (
        analytical(ledger)
        .where(settled(as_of))
        .groupBy("org_id", F.col(account).alias("account"), F.col("posted_at").alias("day"))
        .agg(F.sum(signed("direction", minor("amount"))).alias("net_minor"))
    )
    per = Window.partitionBy("org_id", "account").orderBy("day")
    # A movement is repeated for each day until the next one, so no spine is joined.
    until = F.coalesce(F.date_sub(F.lead("day").over(per), 1), F.lit(as_of))
    running = per.rowsBetween(Window.unboundedPreceding, 0)
    closed = moves.select(
        "org_id", "account", "day", until.alias("until"), F.sum("net_minor").over(running).alias("balance_minor")
    )
    return closed.select(
        "org_id", "account", F.explode(F.sequence("day", "until")).alias("day"), "balance_minor"
    )


def peer_benchmark(rows: DataFrame, cell: Sequence[str], value: str, min_peers: int = 30) -> DataFrame:
    """Quartiles of a rounded percentage per peer cell, only where the cell is large enough."""
    return (
        rows.groupBy(*cell)
        .agg(F.count("*").alias("peers"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
        .where(F.col("peers") >= min_peers)
        .select(
            *cell,
            "peers",
            F.round(F.col("p")[0], 4).alias("p25"),
            F.round(F.col("p")[1], 4).alias("p50"),
            F.round(F.col("p")[2], 4).alias("p75"),
        )
    )


SKETCH_ACCURACY = 1000  # a sketched quantile is off by at most one part in so many of the ranks


def peer_sketch(rows: DataFrame, cell: Sequence[str], value: str, quantiles: Sequence[float], min_peers: int = 30) -> DataFrame:
    """Quantiles `p` per peer cell from sketches: cells of any size, since tasks send sketches and not their values.

    A sketch merges with others of its cell; the rank of its answer is off by one part in `SKETCH_ACCURACY` at most.
    """
    sketched = F.percentile_approx(value, list(quantiles), SKETCH_ACCURACY)
    return rows.groupBy(*cell).agg(F.count("*").alias("peers"), sketched.alias("p")).where(F.col("peers") >= min_peers)


# Weight of each part of the health score.
HEALTH_WEIGHTS = {
    "liquidity": 25,
    "profitability": 20,
    "growth": 15,
    "efficiency": 15,
    "concentration": 15,
    "hygiene": 10,
}


def health_scores(ledger: DataFrame, customers: DataFrame, organizations: DataFrame, period: Period) -> DataFrame:
    """Six sub-scores from named ratios, their weighted sum, and the part that would lift it most."""
    from centavo.operators.breakdowns import concentration
    from centavo.operators.quality import quality_rate

    requests = [
        metrics.MetricRequest(period, ("net_profit", "runway_months")),
        metrics.MetricRequest(prior_year(period), ("revenue",)),
    ]
    m = metrics.with_every_tenant(metrics.measures(ledger, requests), organizations)
    top = concentration(ledger, customers, period).select("org_id", F.col("share").alias("top_share"))
    hygiene = quality_rate(ledger).select("org_id", "uncategorized_share")
    rows = m.join(top, "org_id", "left").join(hygiene, "org_id", "left")

    def col(name: str) -> Column:
        return F.col(name).cast("double")

    revenue, prior = col("r0_revenue_minor"), col("r1_revenue_minor")
    opex = col("r0_opex_minor") + col("r0_payroll_minor")
    profit = revenue - col("r0_cogs_minor") - opex
    mean_net = half_up_mean(F.col("r0_burn_minor"), F.col("r0_burn_n"))
    runway = F.when(mean_net < 0, col("r0_cash_minor") / (-mean_net).cast("double"))

    def score(value: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(value + F.lit(0.5)))).cast("int")

    parts = {
        "liquidity": F.when(F.col("r0_burn_n") < 2, 0).otherwise(
            F.coalesce(score(runway / F.lit(12.0) * F.lit(100.0)), F.lit(100))
        ),
        "profitability": F.when(revenue > 0, score(F.lit(50.0) + profit / revenue * F.lit(200.0))).otherwise(0),
        "growth": F.when(prior > 0, score(F.lit(50.0) + (revenue - prior) / prior * F.lit(100.0))).otherwise(50),
        "efficiency": F.when(revenue > 0, score(F.lit(100.0) - opex / revenue * F.lit(100.0))).otherwise(0),
        "concentration": score(F.lit(100.0) - F.coalesce("top_share", F.lit(1.0)) * F.lit(100.0)),
        "hygiene": score(F.lit(100.0) - F.coalesce("uncategorized_share", F.lit(0.0)) * F.lit(100.0)),
    }
    scored = rows.select("org_id", *[c.cast("int").alias(n) for n, c in parts.items()])
    total = sum((F.col(n) * w for n, w in HEALTH_WEIGHTS.items()), F.lit(0))
    levers = F.array(
        *[F.struct((-(100 - F.col(n)) * w).alias("lost"), F.lit(n).alias("part")) for n, w in HEALTH_WEIGHTS.items()]
    )
    return scored.withColumn("score", F.floor((total + 50) / 100).cast("int")).withColumn(
        "top_lever", F.array_min(levers)["part"]
    )


def expense_anomalies(ledger: DataFrame, month: Period, history: int = 12, sigmas: float = 2.5, floor_pct: int = 3) -> DataFrame:
    """Categories whose month lies above the mean of earlier months by both rules."""
    from centavo.operators.breakdowns import category_label, expense_rows

    first = F.add_months(F.lit(month.start), -history)
    rows = expense_rows(ledger).where((F.col("occurred_at") >= first) & (F.col("occurred_at") <= F.lit(month.end)))
    monthly = rows.groupBy(
        "org_id", category_label().alias("label"), month_start(F.col("occurred_at")).alias("month")
    ).agg(F.sum(minor("amount")).alias("y"))
    now = F.col("month") == F.lit(month.start)
    y = F.col("y").cast("decimal(19,0)")
    per_label = monthly.groupBy("org_id", "label").agg(
        F.coalesce(F.sum(F.when(now, F.col("y"))), _zero()).alias("current_minor"),
        F.count(F.when(~now, 1)).alias("n"),
        F.sum(F.when(~now, F.col("y"))).alias("s1"),
        F.sum(F.when(~now, y * y)).alias("s2"),
    )
    totals = per_label.groupBy("org_id").agg(
        F.sum("current_minor").alias("month_minor"),
        F.sum("n").alias("history_n"),
        F.sum("s1").alias("history_minor"),
        F.sum("s2").alias("history_squares"),
    )
    mean = F.col("s1").cast("double") / F.col("n").cast("double")
    limit = mean + F.lit(sigmas) * _stddev(F.col("n"), F.col("s1"), F.col("s2"))
    excess = F.col("current_minor").cast("double") - mean
    return (
        per_label.join(totals, "org_id")
        .where(
            (F.col("n") >= 2)
            & (F.col("current_minor").cast("double") > limit)
            & (excess * 100 > F.col("month_minor").cast("double") * floor_pct)
        )
        .select(
            "org_id",
            "label",
            "current_minor",
            F.floor(mean + F.lit(0.5)).alias("mean_minor"),
            F.floor(excess + F.lit(0.5)).alias("excess_minor"),
        )
    )


# What each metric needs before it is shown (sources, days of history).
REQUIREMENTS = {
    "revenue": ("accounting", 0),
    "cogs": ("accounting", 0),
    "gross_margin": ("accounting", 60),
    "operating_expenses": ("accounting", 0),
    "net_profit": ("accounting", 30),
    "cash_position": ("banking", 0),
    "monthly_burn": ("banking", 60),
    "runway_months": ("banking", 60),
}


def metric_availability(spans: DataFrame, connected: DataFrame) -> DataFrame:
    """available, insufficient_data or requires_connection for every tenant and metric.

    `spans`: `org_id, history_days`; `connected`: `org_id, source_kind` of live connections.
    """
    kinds = connected.groupBy("org_id").agg(
        *[F.bool_or(F.col("source_kind") == k).alias(k) for k in ("accounting", "banking")]
    )
    rules = F.array(
        *[
            F.struct(
                F.lit(key).alias("metric_key"),
                F.coalesce(F.col(kind), F.lit(False)).alias("connected"),
                F.lit(days).alias("needs_days"),
            )
            for key, (kind, days) in REQUIREMENTS.items()
        ]
    )
    rows = spans.join(kinds, "org_id", "left").select("org_id", "history_days", F.explode(rules).alias("r"))
    state = (
        F.when(~F.col("r.connected"), "requires_connection")
        .when(F.coalesce("history_days", F.lit(0)) < F.col("r.needs_days"), "insufficient_data")
        .otherwise("available")
    )
    return rows.select("org_id", "r.metric_key", state.alias("state"))


def subscription_metrics(
    ledger: DataFrame,
    models: DataFrame,
    as_of: dt.date,
    months: int = 3,
    marketing_categories: Sequence[str] = ("opex.marketing",),
) -> DataFrame:
    """MRR, ARR, churn, CAC and LTV for tenants with a subscription model; other tenants are absent.

    A customer is active in a window when billed in it. MRR is the mean monthly
    revenue of customers billed in both windows; churn is the share of the
    earlier window's customers not billed in the later one. CAC divides the recent cost in the
    marketing categories by the customers gained, and is null where there is no such cost.
    """
    occurred = F.col("occurred_at")
    recent = after_months_before(occurred, as_of, months)
    window = after_months_before(occurred, as_of, 2 * months)
    eligible = models.where(F.col("model") == "subscription").select("org_id")
    rows = analytical(ledger).where(window).join(eligible, "org_id", "left_semi")
    revenue = F.col("statement") == "revenue"
    marketing = (F.col("statement") == "opex") & F.coalesce(F.col("category").isin(*marketing_categories), F.lit(False)) & recent
    per_customer = (
        rows.where(revenue | marketing)
        .groupBy("org_id", F.when(revenue, F.col("customer_id")).alias("customer_id"))
        .agg(
            F.sum(F.when(revenue & recent, minor("amount"))).alias("now_minor"),
            F.sum(F.when(revenue & ~recent, minor("amount"))).alias("before_minor"),
            F.sum(F.when(marketing, minor("amount"))).alias("marketing_minor"),
        )
    )
    now, before = F.col("now_minor").isNotNull(), F.col("before_minor").isNotNull()
    per_org = per_customer.groupBy("org_id").agg(
        F.coalesce(F.sum(F.when(now & before, F.col("now_minor"))), _zero()).alias("recurring"),
        F.coalesce(F.sum("now_minor"), _zero()).alias("revenue"),
        F.sum("marketing_minor").alias("marketing"),
        F.count(F.when(before, 1)).alias("earlier"),
        F.count(F.when(before & ~now, 1)).alias("lost"),
        F.count(F.when(now & ~before, 1)).alias("gained"),
        F.count(F.when(now, 1)).alias("active"),
    )
    mrr = half_up_mean(F.col("recurring"), months)
    churn = share(F.col("lost"), F.col("earlier"))
    arpa = half_up_mean(F.col("revenue"), F.col("active") * months)
    return per_org.select(
        "org_id",
        mrr.alias("mrr_minor"),
        (mrr * 12).alias("arr_minor"),
        F.when(F.col("earlier") > 0, round_half_up(churn, 4)).alias("churn"),
        half_up_mean(F.col("marketing"), F.col("gained")).alias("cac_minor"),
        F.when(F.col("lost") > 0, F.floor(arpa.cast("double") * months / churn + F.lit(0.5))).alias("ltv_minor"),
    )


def access_anomalies(log: DataFrame, days: int = 7, sigmas: float = 2.0) -> DataFrame:
    """Users whose reads in a day exceed their trailing mean by `sigmas` deviations.

    `log`: `user_id, day`. Counts per user and day come first; the window runs over days.
    """
    return unusual_days(log.groupBy("user_id", "day").agg(F.count("*").alias("n")), days, sigmas)


def unusual_days(daily: DataFrame, days: int = 7, sigmas: float = 2.0) -> DataFrame:
    """The same from counts per user and day (`user_id, day, n`)."""
    index = F.datediff(F.col("day"), F.lit(dt.date(1970, 1, 1)))
    trailing = Window.partitionBy("user_id").orderBy("_i").rangeBetween(-days, -1)
    rows = daily.withColumn("_i", index).withColumns(
        {
            "seen": F.count("*").over(trailing),
            "s1": F.sum("n").over(trailing),
            "s2": F.sum(F.col("n") * F.col("n")).over(trailing),
        }
    )
    mean = F.col("s1").cast("double") / F.col("seen").cast("double")
    limit = mean + F.lit(sigmas) * _stddev(F.col("seen"), F.col("s1"), F.col("s2"))
    return rows.where((F.col("seen") >= 3) & (F.col("n").cast("double") > limit)).select(
        "user_id", "day", "n", round_half_up(mean, 4).alias("trailing_mean")
    )


def seasonal_index(ledger: DataFrame, statement: str, months: Period) -> DataFrame:
    """Month-of-year share of an average month, per tenant; full months only."""
    rows = analytical(ledger).where((F.col("statement") == statement) & months.contains(F.col("occurred_at")))
    monthly = rows.groupBy("org_id", month_start(F.col("occurred_at")).alias("month")).agg(
        F.sum(minor("amount")).alias("y")
    )
    by_moy = monthly.groupBy("org_id", F.month("month").alias("month_of_year")).agg(
        F.sum("y").alias("y"), F.count("*").alias("n")
    )
    per_org = Window.partitionBy("org_id")
    mean = F.sum("y").over(per_org).cast("double") / F.sum("n").over(per_org).cast("double")
    own = F.col("y").cast("double") / F.col("n").cast("double")
    return by_moy.select("org_id", "month_of_year", round_half_up(F.try_divide(own, mean), 4).alias("seasonal_index"))


def tax_set_aside(ledger: DataFrame, year_to_date: Period, rates: DataFrame) -> DataFrame:
    """Estimated tax to put aside: profit so far times the tenant's rate, never negative."""
    totals = metrics.statement_totals(ledger, year_to_date)
    profit = F.col("revenue_minor") - F.col("cogs_minor") - F.col("opex_minor") - F.col("payroll_minor")
    return (
        totals.select("org_id", profit.alias("profit_minor"))
        .join(rates, "org_id")
        .select(
            "org_id",
            "profit_minor",
            F.round(F.greatest("profit_minor", _zero()).cast("decimal(19,0)") * F.col("rate")).cast("bigint").alias(
                "set_aside_minor"
            ),
        )
    )


def outgrowing_categories(ledger: DataFrame, period: Period) -> DataFrame:
    """Categories that grew faster than revenue against the period before, with the yearly cost."""
    from centavo.operators.breakdowns import category_label

    before = previous(period)
    occurred = F.col("occurred_at")
    label = F.when(F.col("statement") == "revenue", F.lit(None)).otherwise(category_label())
    rows = analytical(ledger).where(
        F.col("statement").isin("revenue", *EXPENSE_STATEMENTS) & (period.contains(occurred) | before.contains(occurred))
    )
    sums = rows.groupBy("org_id", label.alias("label")).agg(
        F.coalesce(F.sum(F.when(period.contains(occurred), minor("amount"))), _zero()).alias("now_minor"),
        F.coalesce(F.sum(F.when(before.contains(occurred), minor("amount"))), _zero()).alias("before_minor"),
    )
    revenue = sums.where(F.col("label").isNull()).select(
        "org_id", F.col("now_minor").alias("revenue_now"), F.col("before_minor").alias("revenue_before")
    )
    costs = sums.where(F.col("label").isNotNull() & (F.col("before_minor") > 0))
    growth = F.col("now_minor").cast("double") / F.col("before_minor").cast("double")
    base = F.col("revenue_now").cast("double") / F.col("revenue_before").cast("double")
    return (
        costs.join(revenue.where(F.col("revenue_before") > 0), "org_id")
        .where((growth > base) & (F.col("now_minor") > F.col("before_minor")))
        .select(
            "org_id",
            "label",
            "now_minor",
            "before_minor",
            round_half_up(growth * 100 - 100, 2).alias("growth_pct"),
            round_half_up(base * 100 - 100, 2).alias("revenue_growth_pct"),
        )
    )


def price_changes(rows: DataFrame, least_months: int = 3, rise: float = 1.1) -> DataFrame:
    """The month in which the price per unit of a vendor's item rose for good, if it did by `rise` or more.

    `rows`: `org_id, vendor_id, item, day, cost_minor, units`. Of all months that part an item's history in two, with at least
    `least_months` of purchases on either side, the one taken explains most of the variation of the price, units
    as weights; of equals the earliest. Purchases come down to months first; the windows run over months.
    """
    keys = ["org_id", "vendor_id", "item"]
    monthly = rows.groupBy(*keys, month_start(F.col("day")).alias("month")).agg(F.sum("cost_minor").alias("cost"), F.sum("units").alias("units"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    split = monthly.select(
        *keys, "month",
        F.sum("cost").over(before).alias("cost0"), F.sum("units").over(before).alias("units0"), F.count("*").over(before).alias("months0"),
        F.sum("cost").over(whole).alias("cost"), F.sum("units").over(whole).alias("units"), F.count("*").over(whole).alias("months"),
    ).where((F.col("months0") >= least_months) & (F.col("months") - F.col("months0") >= least_months))
    old = F.col("cost0").cast("double") / F.col("units0").cast("double")
    later = (F.col("units") - F.col("units0")).cast("double")
    new = (F.col("cost") - F.col("cost0")).cast("double") / later
    weight = F.col("units0").cast("double") * later / F.col("units").cast("double")
    priced = split.select(*keys, "month", old.alias("old"), new.alias("new"), later.alias("later"), weight.alias("weight"))
    gained = priced.withColumn("gain", (F.col("new") - F.col("old")) * (F.col("new") - F.col("old")) * F.col("weight"))
    best = latest_by(gained, keys, [F.col("gain").desc(), F.col("month")]).where(F.col("new") >= F.col("old") * rise)
    return best.select(
        *keys,
        F.col("month").alias("changed_in"),
        F.floor(F.col("old") + 0.5).cast("double").alias("before_minor"),
        F.floor(F.col("new") + 0.5).cast("double").alias("after_minor"),
        F.floor((F.col("new") - F.col("old")) * F.col("later") + 0.5).cast("bigint").alias("extra_minor"),
    )
