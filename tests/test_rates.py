"""Dated rates, metrics at any grain and components, each against its definition."""

import datetime as dt
import random
from decimal import Decimal

from centavo.functions.periods import Period, month_period
from centavo.operators import metrics
from centavo.operators.components import components
from centavo.operators.rates import rates_on, to_base
from centavo.sources.books import Books

D0 = dt.date(2001, 1, 1)


def test_the_last_rate_on_or_before_the_day(spark):
    rng = random.Random(1)
    rates = [(rng.choice(["EUR", "GBP"]), D0 + dt.timedelta(days=rng.randrange(20, 60)), Decimal(rng.randrange(1, 999)) / 100) for _ in range(30)]
    rows = [(i, rng.choice(["EUR", "GBP", "USD", "JPY", None]), rng.choice([None, D0 + dt.timedelta(days=rng.randrange(90))]), Decimal(rng.randrange(1, 9999)) / 100) for i in range(200)]
    frame = spark.createDataFrame(rows, "id int, currency string, day date, amount decimal(20,4)")
    told = spark.createDataFrame([*rates, ("EUR", D0, None)], "currency string, day date, rate decimal(18,10)")
    got = {r.id: r for r in to_base(frame, told, "USD", "amount", "id").collect()}
    assert len(got) == len(rows)
    for i, currency, day, amount in rows:
        known = [(d, r) for c, d, r in rates if c == currency and day is not None and d <= day]
        want = (day, Decimal(1)) if currency == "USD" else max(known) if known else (None, None)
        assert (got[i].rate_day, got[i].rate) == want, (i, currency, day)
        assert got[i].rate_missing == (want[1] is None)
        assert got[i].base_amount == (None if want[1] is None else round(amount * want[1], 4))


def test_rates_are_not_met_by_a_range_join(spark):
    days = spark.createDataFrame([("EUR", D0)], "currency string, day date")
    rates = spark.createDataFrame([("EUR", D0, Decimal(2))], "currency string, day date, rate decimal(18,10)")
    text = rates_on(days, rates)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert rates_on(days.limit(0), rates).count() == 0


def test_a_long_chain_settles_in_few_rounds(spark):
    name = lambda i: f"k{(i * 7919) % 1009:04d}"  # noqa: E731  # neighbours far apart in order
    links = [(1, name(i), name(i + 1)) for i in range(1000)] + [(2, "a", "b"), (2, "b", "a"), (2, "c", "c"), (1, "z", "z")]
    rounds: list[int] = []
    got = components(spark.createDataFrame(links, "org int, a string, b string"), ["org"], rounds).collect()
    least = min(name(i) for i in range(1001))
    assert {(r.org, r.key): r.canonical for r in got} == {(1, name(i)): least for i in range(1001)} | {(2, "a"): "a", (2, "b"): "a"}
    assert len(got) == 1003 and len(rounds) <= 15


def test_buckets_equal_the_metric_table(spark, small):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    books = Books(spark, small, stored=True)
    period = Period(dt.date(2001, 5, 10), dt.date(2001, 7, 31))
    grains = metrics.metric_grains(books.ledger, period, books.organizations, ("month", "year"))
    rows = {(r.grain, r.bucket_start, r.org_id, r.metric_key): r for r in grains.collect()}
    for grain, start, asked in (
        ("month", dt.date(2001, 6, 1), month_period(2001, 6)),
        ("month", dt.date(2001, 5, 1), Period(period.start, dt.date(2001, 5, 31))),
        ("year", dt.date(2001, 1, 1), period),
    ):
        for r in metrics.metric_table(books.ledger, asked, None, books.organizations).collect():
            got = rows[grain, start, r.org_id, r.metric_key]
            assert got.bucket_end == asked.end
            assert (got.value_minor, got.value, got.confidence, got.reason, got.source_count) == (r.value_minor, r.value, r.confidence, r.reason, r.source_count), (grain, start, r)


def test_grains_scan_the_ledger_once(spark, small, monkeypatch):
    books = Books(spark, small, stored=True)
    seen = []
    monkeypatch.setattr(metrics, "written", lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df.limit(0))
    metrics.metric_grains(books.ledger, month_period(2001, 6), books.organizations, ("day", "week"), ["net_profit"])
    assert len(seen) == 1 and seen[0].count("FileScan") == 1
