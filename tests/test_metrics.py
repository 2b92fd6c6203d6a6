"""Hand-worked books for rules that the SQL twin would only repeat."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from centavo.functions.periods import Period, month_period, trailing_months
from centavo.operators import behavior, breakdowns, metrics, tenancy
from centavo.operators.predicates import analytical

LEDGER = (
    "org_id int, source_txn_id string, source_record_type string, direction string, amount decimal(20,4), "
    "occurred_at date, posted_at date, merchant_name string, category string, statement string, "
    "customer_id bigint, is_canonical boolean, is_transfer boolean, is_voided boolean"
)
END = dt.date(2001, 8, 1)


def row(org=1, key="t", direction="outflow", amount="10", day=END, posted=None, statement="opex", **more):
    base = dict(
        org_id=org,
        source_txn_id=key,
        source_record_type="Purchase",
        direction=direction,
        amount=Decimal(amount),
        occurred_at=day,
        posted_at=posted,
        merchant_name=None,
        category=None,
        statement=statement,
        customer_id=None,
        is_canonical=True,
        is_transfer=False,
        is_voided=False,
    )
    base.update(more)
    return tuple(base.values())


def ledger(spark, rows):
    return spark.createDataFrame(rows, LEDGER)


def metric(spark, rows, *keys, period=trailing_months(END, 12), orgs=(1,)):
    table = metrics.metric_table(
        ledger(spark, rows), period, keys, spark.createDataFrame([(o,) for o in orgs], "org_id int")
    )
    return {(r.org_id, r.metric_key): r for r in table.collect()}


def cash(amount, day, org=1):
    direction = "inflow" if amount > 0 else "outflow"
    return row(org, direction=direction, amount=str(abs(amount)), day=day, posted=day, statement=None)


@pytest.mark.parametrize(
    "months, value, confidence",
    [(1, None, "insufficient_data"), (2, 10_000, "medium"), (3, 10_000, "medium"), (4, 10_000, "high")],
)
def test_burn_needs_two_months_and_is_high_from_four(spark, months, value, confidence):
    rows = [cash(-100, dt.date(2001, 7 - i, 15)) for i in range(months)]
    got = metric(spark, rows, "monthly_burn", "runway_months")
    burn = got[1, "monthly_burn"]
    assert (burn.value_minor, burn.confidence) == (value, confidence)
    assert (got[1, "runway_months"].value is None) == (value is None)


def test_cash_positive_business_burns_nothing_and_has_no_runway_limit(spark):
    got = metric(spark, [cash(50, dt.date(2001, m, 1)) for m in (5, 6, 7)], "monthly_burn", "runway_months")
    assert got[1, "monthly_burn"].value_minor == 0
    assert got[1, "runway_months"].value is None
    assert got[1, "runway_months"].confidence == "high"
    assert "no limit" in got[1, "runway_months"].reason


def test_missing_revenue_is_not_zero_margin(spark):
    got = metric(spark, [row(statement="cogs")], "gross_margin", "revenue", "net_profit")
    assert got[1, "gross_margin"].value is None
    assert got[1, "gross_margin"].confidence == "insufficient_data"
    assert got[1, "revenue"].confidence == "insufficient_data"
    assert got[1, "net_profit"].value_minor == -1000


def test_tenant_without_rows_is_reported(spark):
    got = metric(spark, [row(org=2)], "revenue", "cash_position", orgs=(1, 2))
    assert got[1, "revenue"].confidence == "insufficient_data"
    assert got[1, "cash_position"].source_count == 0


def test_mirrors_transfers_and_voided_rows_never_count(spark):
    rows = [row(amount="5"), row(is_canonical=False), row(is_transfer=True), row(is_voided=True)]
    assert analytical(ledger(spark, rows)).count() == 1
    assert metric(spark, rows, "operating_expenses")[1, "operating_expenses"].value_minor == 500


def test_period_ends_are_included(spark):
    july = month_period(2001, 7)
    rows = [row(day=d) for d in (dt.date(2001, 6, 30), july.start, july.end, END)]
    assert metric(spark, rows, "operating_expenses", period=july)[1, "operating_expenses"].source_count == 2


def test_burn_asked_for_two_end_dates_is_refused(spark):
    requests = [metrics.MetricRequest(month_period(2001, m), ("monthly_burn",)) for m in (6, 7)]
    with pytest.raises(ValueError):
        metrics.measures(ledger(spark, [row()]), requests)


def test_categorised_expense_adds_up_to_total(spark):
    rng = random.Random(3)
    rows = [
        row(
            amount=f"{rng.randrange(1, 10**6)}.{rng.randrange(100):02d}",
            statement=rng.choice(["opex", "cogs", "payroll"]),
            category=rng.choice([None, "a", "b", "c"]),
        )
        for _ in range(300)
    ]
    parts = breakdowns.expenses_by_category(ledger(spark, rows), Period(END, END)).collect()
    total = sum(int(Decimal(r[4]) * 100) for r in rows)
    assert sum(p.total_minor for p in parts) == total
    assert abs(sum(p.share for p in parts) - 1) < 1e-9
    assert {p.org_source_count for p in parts} == {300}


def test_transfer_pair_leaves_profit_unchanged(spark):
    base = [row(amount="7"), row(direction="inflow", amount="20", statement="revenue")]
    pair = [row(amount="99", is_transfer=True), row(direction="inflow", amount="99", is_transfer=True)]
    a = metric(spark, base, "net_profit", "cash_position")
    b = metric(spark, base + pair, "net_profit", "cash_position")
    assert [r.value_minor for r in a.values()] == [r.value_minor for r in b.values()]


def test_missing_due_date_is_the_oldest_bucket(spark):
    docs = spark.createDataFrame(
        [(1, None, Decimal(5), "open"), (1, END, Decimal(1), "open"), (1, dt.date(2001, 7, 2), Decimal(2), "overdue")],
        "org_id int, due_date date, balance decimal(20,4), status string",
    )
    got = {r.bucket: r.balance_minor for r in breakdowns.receivables_aging(docs, END).collect()}
    assert got == {"90+ days": 500, "Current": 100, "1-30 days": 200}


def test_behaviour_by_rank_matches_sorting(spark):
    rng = random.Random(4)
    start = dt.date(2001, 1, 1)
    rows, lags = [], {}
    for customer in range(12):
        n = rng.randrange(1, 30)
        lags[customer] = sorted(rng.randrange(-5, 40) for _ in range(n))
        rows += [(1, customer, "paid", start + dt.timedelta(days=x), start) for x in lags[customer]]
    docs = spark.createDataFrame(rows, "org_id int, customer_id bigint, status string, paid_on date, due_date date")
    got = {r.customer_id: r for r in behavior.fit_behavior_by_rank(docs).collect()}
    assert set(got) == {c for c, v in lags.items() if len(v) >= 4}
    for c, r in got.items():
        v = lags[c]
        assert (r.p50, r.p90, r.sample_count) == (v[int(len(v) * 0.5)], v[int(len(v) * 0.9)], len(v))
    exact = {r.customer_id: r for r in behavior.fit_behavior(docs).collect()}
    assert set(exact) == set(lags)


UUID_A = "3f2504e0-4f89-41d3-9a0c-0305e82c3301"
UUID_B = "3f2504e0-4f89-41d3-9a0c-0305e82c3302"


def test_tenant_scope_fails_closed(spark):
    df = spark.createDataFrame([(UUID_A, 1), (UUID_B, 2), (None, 3)], "org_id string, v int")
    assert [r.v for r in tenancy.scoped(df, UUID_A).collect()] == [1]
    assert [r.v for r in tenancy.scoped(df, UUID_A.upper()).collect()] == [1]
    assert tenancy.scoped(df, None).count() == 0
    assert tenancy.scoped(df, "").count() == 0
    assert sorted(r.v for r in tenancy.scoped_with_shared(df, UUID_B).collect()) == [2, 3]
    for bad in ("1 OR 1=1", "not-a-uuid", 7):
        with pytest.raises(tenancy.TenantError):
            tenancy.scoped(df, bad)


def test_writing_a_row_of_another_tenant_fails(spark):
    df = spark.createDataFrame([(UUID_A, 1), (UUID_B, 2)], "org_id string, v int")
    assert tenancy.checked_writes(df.where("v = 1"), UUID_A).count() == 1
    with pytest.raises(Exception, match="another tenant"):
        tenancy.checked_writes(df, UUID_A).collect()


def test_drill_down_rows_add_up(spark):
    rows = [row(key=f"t{i}", amount=str(i)) for i in range(1, 130)]
    got = breakdowns.drill_down(ledger(spark, rows), statement="opex").orderBy("rank").collect()
    assert len(got) == 100 and got[0].amount_minor == 12_900 and got[-1].amount_minor == 3_000


def test_metric_plan_reads_only_what_it_needs(spark, small):
    from centavo.sources.books import Books

    df = metrics.metric_table(Books(spark, small).ledger, trailing_months(END, 12), ["revenue"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert F is not None
