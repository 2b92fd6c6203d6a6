"""Forecast against a plain day-by-day loop over the same facts."""

import datetime as dt
import math
import random
from decimal import Decimal

import pytest

from centavo.plans import alerts, scenarios
from centavo.plans import forecast as fc
from tests.test_metrics import ledger, row

AS_OF = dt.date(2001, 8, 1)
O = fc.ForecastOptions(as_of=AS_OF)
INVOICE = (
    "org_id int, invoice_id bigint, customer_id bigint, issued_on date, due_date date, "
    "total decimal(20,4), balance decimal(20,4), paid_on date, status string"
)
CUSTOMER = "org_id int, customer_id bigint, name string"


def day(n):
    return AS_OF + dt.timedelta(days=n)


def pay(n, amount="1000", **more):
    return row(day=day(n), amount=amount, statement="payroll", posted=day(n), **more)


def invoice(key, due, balance, customer=1, issued=-200, paid=None, total=None, status="open"):
    return (1, key, customer, day(issued), None if due is None else day(due), Decimal(total or balance), Decimal(balance), None if paid is None else day(paid), status)


def facts(spark, rows, docs=(), o=O, names=((1, 1, "One"), (1, 2, "Two"))):
    return fc.forecast_inputs(
        ledger(spark, list(rows)),
        spark.createDataFrame(list(docs), INVOICE),
        spark.createDataFrame([(1,)], "org_id int"),
        o,
        spark.createDataFrame(list(names), CUSTOMER),
    )


def test_cadence_is_the_upper_median_gap(spark):
    # Gaps 5, 10, 15, 16: the upper median is 15, the plain median would be 12.5.
    days = [-46, -41, -31, -16, 0]
    r = facts(spark, [pay(n) for n in days]).first()
    assert r.cadence_days == 15 and r.typical_payroll_minor == 100_000
    assert r.pay_days == [15, 30, 45, 60, 75, 90]


@pytest.mark.parametrize("gap", [4, 41])
def test_cadence_outside_the_usual_range_is_ignored(spark, gap):
    r = facts(spark, [pay(-gap), pay(0)]).first()
    assert r.cadence_days is None and r.pay_days == []


def test_one_payroll_gives_no_projection(spark):
    assert facts(spark, [pay(-3)]).first().pay_days == []


def test_typical_payroll_uses_the_last_six(spark):
    rows = [pay(-10 * i, str(100 * (i + 1))) for i in range(9)]
    assert facts(spark, rows).first().typical_payroll_minor == 35_000


def test_receivables_use_observed_lateness(spark):
    paid = [invoice(i, -100, "0", paid=-100 + 20, total="5", status="paid") for i in range(4)]
    few = [invoice(10 + i, -100, "0", customer=2, paid=-99, total="5", status="paid") for i in range(3)]
    docs = [
        *paid,
        *few,
        invoice(20, 10, "100"),
        invoice(21, 10, "50", customer=2),
        invoice(22, -60, "7"),
        invoice(23, None, "3", customer=2),
        invoice(24, -20, "9"),
    ]
    got = {e.day: e.balance_minor for e in facts(spark, [], docs).first().receivables}
    # Known lateness of 20 days; the prior of 14; long overdue and exactly today land in five days.
    assert got == {30: 10_000, 24: 5_000, 5: 700 + 900, 14: 300}


def loop(r, o):
    """The projection as a loop over days, from the same inputs row."""
    balance, committed, receivable, variable = r.starting_cash_minor, 0, 0, 0
    out = []
    for i in range(1, o.horizon_days + 1):
        date = o.as_of + dt.timedelta(days=i)
        out_flow = (r.typical_payroll_minor if i in r.pay_days else 0) + sum(
            v.vendor_minor for v in (r.vendor_days or []) if v.dom == date.day
        )
        in_flow = sum(e.balance_minor for e in (r.receivables or []) if e.day == i)
        if date.day == 1 and i > r.collection_lag_days:
            in_flow += r.new_revenue_minor
        committed -= out_flow
        receivable += in_flow
        variable -= r.daily_variable_minor
        balance += in_flow - out_flow - r.daily_variable_minor
        spread = math.floor(math.sqrt(i) * abs(r.daily_variable_minor) * 2.6 + i * 18000.0 + 0.5)
        out.append((date, balance - spread, balance, balance + math.floor(spread * 0.85 + 0.5), committed, receivable, variable))
    return out


def random_books(rng):
    rows = [pay(-14 * i - rng.randrange(2), str(rng.randrange(500, 3000))) for i in range(7)]
    for i in range(120):
        rows.append(
            row(
                day=day(-rng.randrange(0, 115)),
                amount=str(rng.randrange(1, 900)),
                statement=rng.choice(["opex", "cogs"]),
                merchant_name=rng.choice([None, "a", "b", "c", "d"]),
                posted=rng.choice([None, day(-1)]),
            )
        )
    rows.append(row(direction="inflow", amount="40000", posted=day(-120), day=day(-120), statement="asset"))
    docs = [
        invoice(i, rng.choice([None, *range(-50, 80)]), str(rng.randrange(1, 5000)), customer=rng.choice([1, 2]), issued=-rng.randrange(1, 180))
        for i in range(40)
    ]
    docs += [invoice(100 + i, -100, "0", customer=1, issued=-120, paid=-100 + rng.randrange(30), total="900", status="paid") for i in range(6)]
    return rows, docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_points_match_the_loop_and_bands_are_ordered(spark, seed):
    rows, docs = random_books(random.Random(seed))
    inputs = facts(spark, rows, docs)
    got = [
        (p.date, p.p10, p.p50, p.p90, p.committed, p.receivables, p.variable)
        for p in fc.forecast_points(inputs, O).orderBy("date").collect()
    ]
    assert got == loop(inputs.first(), O)
    assert all(p10 <= p50 <= p90 for _, p10, p50, p90, *_ in got)


@pytest.mark.parametrize("seed", [4, 5])
def test_late_invoices_behind_a_payroll_risk(spark, seed):
    rows, docs = random_books(random.Random(seed))
    rows = [r for r in rows if r[3] != "inflow"] + [row(amount="90000", day=day(-110), posted=day(-110), statement=None)]
    inputs = facts(spark, rows, docs)
    r = inputs.first()
    risks = fc.forecast_risks(inputs, O).where("kind = 'payroll_shortfall'").collect()
    assert risks
    mean = {c: (sum(x) / len(x) if len(x) >= 4 else 14) for c, x in _lags(docs).items()}
    for risk in risks:
        late = []
        for _, key, customer, _, due, _, balance, _, status in docs:
            if status == "paid":
                continue
            late_days = math.floor(round(mean.get(customer, 14), 2) + 0.5)
            expected = (due or AS_OF) + dt.timedelta(days=late_days)
            expected = day(5) if expected <= AS_OF else expected
            if expected > risk.date:
                late.append((-int(balance * 100), key))
        top = sorted(late)[:3]
        collect = [a for a in risk.actions if a.type == "collect"]
        assert (collect[0].impact_minor if collect else 0) == -sum(b for b, _ in top)
        assert risk.severity == ("critical" if risk.days_away <= 7 else "high" if risk.days_away <= 21 else "medium")
        assert [a.impact_minor for a in risk.actions if a.type == "finance"] == [risk.shortfall_minor]
    assert r.cadence_days


def _lags(docs):
    out = {}
    for _, _, customer, _, due, _, _, paid, status in docs:
        if status == "paid":
            out.setdefault(customer, []).append((paid - due).days)
    return out


def test_checking_the_balance_before_the_run_needs_half_the_cash(spark):
    rows = [pay(-14, "1000"), pay(0, "1000"), row(direction="inflow", amount="3500", posted=day(-30), day=day(-30), statement="asset")]
    after = fc.forecast_risks(facts(spark, rows), O).where("kind = 'payroll_shortfall'").collect()
    before = fc.forecast_risks(facts(spark, rows, o=fc.ForecastOptions(as_of=AS_OF, pre_run=True)), fc.ForecastOptions(as_of=AS_OF, pre_run=True)).where("kind = 'payroll_shortfall'").collect()
    assert min(r.days_away for r in after) < min(r.days_away for r in before)


def test_runway_risk_only_without_a_negative_day(spark):
    rows = [row(direction="inflow", amount="10000", posted=day(-30), day=day(-30), statement="asset")]
    rows += [row(day=day(-30 * i), amount="2400", merchant_name="landlord") for i in range(1, 4)]
    kinds = {r.kind for r in fc.forecast_risks(facts(spark, rows), O).collect()}
    assert kinds == {"runway_threshold"}


def test_snapshot_holds_everything(spark):
    rows, docs = random_books(random.Random(6))
    (snap,) = fc.forecast_snapshot(facts(spark, rows, docs), O).collect()
    assert len(snap.points) == 91 and len(snap.assumptions) == 3
    assert [p.date for p in snap.points] == sorted(p.date for p in snap.points)


def test_scenario_moves_cash_by_its_parts(spark):
    rows, docs = random_books(random.Random(7))
    s = scenarios.Scenario("equipment", from_day=10, one_off_minor=-500_000, monthly_revenue_minor=1_000)
    (r,) = scenarios.compare(facts(spark, rows, docs), O, s).collect()
    firsts = sum(1 for i in range(10, 92) if day(i).day == 1)
    assert r.difference_minor == -500_000 + 1_000 * firsts


def test_alert_limit_lets_critical_pass(spark):
    rows = [(1, "a", "critical", None, f"a:{i}", i) for i in range(3)] + [(1, "b", "high", None, f"b:{i}", i) for i in range(4)]
    df = spark.createDataFrame(rows, "org_id int, rule_key string, severity string, due_on date, dedup_key string, materiality_minor bigint")
    got = alerts.select_for_week(df).collect()
    assert sorted(r.dedup_key for r in got) == ["a:0", "a:1", "a:2", "b:2", "b:3"]


def test_alert_lifecycle(spark):
    today = spark.createDataFrame(
        [(1, "new", "high", day(3)), (1, "again", "high", day(7)), (1, "still", "high", day(6)), (1, "no", "high", day(2))],
        "org_id int, dedup_key string, severity string, due_on date",
    )
    old = spark.createDataFrame(
        [(1, "again", "sent"), (1, "still", "sent"), (1, "no", "dismissed"), (1, "gone", "sent")],
        "org_id int, dedup_key string, state string",
    )
    got = {r.dedup_key: r.action for r in alerts.lifecycle(today, old, AS_OF).collect()}
    assert got == {"new": "new", "again": "repeat", "still": "ongoing", "no": "suppressed", "gone": "resolved"}
