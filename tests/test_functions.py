import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from centavo.functions import money, periods, text


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_parse_minor_accepts_plain_decimals_only(spark):
    got = column(
        spark,
        ["14200.0000", "-1234.56", "0.1", " 7 ", "1e5", "", "1.005", "abc", "12.", ".5", "1.500"],
        "string",
        money.parse_minor,
    )
    assert got == [1420000, -123456, 10, 700, None, None, None, None, None, None, 150]


def test_round_minor_is_half_away_from_zero(spark):
    got = column(spark, ["1.005", "-1.005", "2.675", "-0.004"], "string", money.round_minor)
    assert got == [101, -101, 268, 0]


def test_minor_and_major_round_trip(spark):
    rng = random.Random(1)
    values = [rng.randrange(-(10**12), 10**12) for _ in range(2000)]
    got = column(spark, values, "bigint", lambda v: money.minor(money.major(v)))
    assert got == values


def test_allocate_loses_no_cent(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(-(10**9), 10**9), rng.randrange(1, 40)) for _ in range(1000)]
    df = spark.createDataFrame(rows, "v bigint, n int").select("v", "n", money.allocate(F.col("v"), F.col("n")).alias("a"))
    for r in df.collect():
        assert len(r.a) == r.n and sum(r.a) == r.v
        assert max(r.a) - min(r.a) <= 1
    assert column(spark, [100, -100], "bigint", lambda v: money.allocate(v, 3)) == [[34, 33, 33], [-34, -33, -33]]


def test_half_up_mean_goes_toward_plus_infinity(spark):
    rows = [(5, 2), (-5, 2), (7, 3), (-7, 3), (0, 4), (1, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s bigint, n bigint")
    got = [r.m for r in df.select("i", money.half_up_mean(F.col("s"), F.col("n")).alias("m")).orderBy("i").collect()]
    assert got == [3, -2, 2, -2, 0, None]


def test_format(spark):
    assert column(spark, [123456789, -5, 0], "bigint", money.format_usd) == ["$1,234,567.89", "-$0.05", "$0.00"]


def test_sum_refuses_mixed_currency(spark):
    ok = spark.createDataFrame([(1, "USD"), (2, "USD")], "v bigint, c string")
    assert ok.agg(money.sum_one_currency("v", "c").alias("s")).first().s == 3
    mixed = spark.createDataFrame([(1, "USD"), (2, "EUR")], "v bigint, c string")
    with pytest.raises(Exception, match="currency mismatch"):
        mixed.agg(money.sum_one_currency("v", "c").alias("s")).collect()


def test_month_arithmetic_clamps():
    assert periods.shift_months(dt.date(2026, 8, 31), -6) == dt.date(2026, 2, 28)
    assert periods.shift_months(dt.date(2024, 1, 31), 1) == dt.date(2024, 2, 29)
    assert periods.month_period(2024, 2).end == dt.date(2024, 2, 29)
    last = periods.last_days(dt.date(2001, 8, 1), 30)
    before = periods.previous(last)
    assert last.days == before.days == 30 and before.end == dt.date(2001, 7, 2)


def test_fiscal_year(spark):
    days = [dt.date(2024, 6, 30), dt.date(2024, 7, 1), dt.date(2025, 1, 15)]
    assert column(spark, days, "date", lambda v: periods.fiscal_year(v, 7)) == [2023, 2024, 2024]


def test_merchant_key(spark):
    raw = ["SQ *BLUE BOTTLE #1234", "PAYPAL *Figma 00012345", "Blue  Bottle", None]
    assert column(spark, raw, "string", text.merchant_key) == ["blue bottle", "figma", "blue bottle", None]


def test_scale_minor(spark):
    assert column(spark, [1000, -1000, 5], "bigint", lambda v: money.scale_minor(v, "1.30")) == [1300, -1300, 7]
    assert Decimal("1.30") * 5 == Decimal("6.50")
