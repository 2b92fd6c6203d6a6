"""The stored ledger: merge, replay, pruning."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from centavo import schemas
from centavo.functions.periods import month_period, trailing_months
from centavo.operators import breakdowns, metrics
from centavo.session import fresh_path
from centavo.sources.books import AS_OF, Books
from centavo.sources.ledger import LedgerTable, bucket_of, buckets_for


def row(org, txn, day, amount=1, kind="Bill", source="accounting", voided=False):
    at = dt.date.fromisoformat(day) if day else None
    return (org, source, txn, kind, "outflow", amount, at, None, "m", None, "opex", None, True, False, voided)


@pytest.fixture
def table(spark):
    return LedgerTable(spark, fresh_path(spark, "ledger-test"), schemas.LEDGER, 4)


def frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.LEDGER.fields).replace("decimal(20,4)", "bigint")).withColumn(
        "amount", F.col("amount").cast("decimal(20,4)")
    )


def kept(table):
    return sorted((r.org_id, r.source, r.source_txn_id or "", str(r.occurred_at), int(r.amount), r.is_voided) for r in table.read().collect())


def test_merge_by_key(spark, table):
    table.merge(frame(spark, [row(1, "a", "2001-01-05"), row(1, "a", "2001-01-04", 2), row(2, "a", "2001-01-05"), row(1, "v", "2001-02-01", voided=True), row(3, None, "2001-01-01")]), 0)
    assert len(kept(table)) == 4 and (1, "accounting", "a", "2001-01-04", 2, False) in kept(table)
    second = [
        row(1, "a", "2001-03-01", 9),  # the key is there, in another month
        row(1, "a", "2001-03-01", 9, source="bank"),  # another source
        row(1, "a", "2001-03-01", 9, kind="Invoice"),  # another record type
        row(1, "v", "2001-02-01", 9),  # its key is held by a voided row only
        row(3, None, "2001-01-01"),  # no key
        row(4, "n", None),  # no day
    ]
    for _ in range(2):  # again as after a crash
        table.merge(frame(spark, second), 1)
    got = kept(table)
    assert len(got) == 9 and sum(r[4] == 9 for r in got) == 3 and sum(r[0] == 3 for r in got) == 2


def test_a_batch_replaces_its_own_rows_after_later_ones(spark, table):
    table.merge(frame(spark, [row(1, "a", "2001-01-05")]), 0)
    table.merge(frame(spark, [row(1, "b", "2001-01-06")]), 1)
    table.merge(frame(spark, [row(1, "c", "2001-01-07"), row(1, "a", "2001-01-05")]), 2)
    table.merge(frame(spark, [row(1, "b", "2001-01-06")]), 1)
    assert [r[2] for r in kept(table)] == ["a", "b", "c"]


def test_other_partitions_keep_their_files(spark, table):
    table.merge(frame(spark, [row(o, f"t{o}", f"2001-0{m}-05", m) for o in range(6) for m in (1, 2)][::-1]), 0)
    before = set(table.read().where("occurred_month = DATE '2001-01-01'").inputFiles())
    table.merge(frame(spark, [row(1, "x", "2001-02-09")]), 1)
    assert before <= set(table.read().inputFiles())
    assert {f.split("occurred_month=")[1][:7] for f in set(table.read().inputFiles()) - before if "batch_id=1" in f} == {"2001-02"}


def test_tenants_read_their_bucket(spark, table):
    table.merge(frame(spark, [row(o, f"t{o}", "2001-01-05") for o in range(20)]), 0)
    assert sorted(r.org_id for r in table.read(orgs=[3, 7]).collect()) == [3, 7]
    assert table.read(orgs=[]).count() == 0
    bucket = spark.range(1).select(bucket_of(F.lit(3), 4)).first()[0]
    scan = plan(table.read(orgs=[3]))
    assert "org_bucket" in scan.split("PartitionFilters")[1].split("]")[0]
    assert table.read(orgs=[3]).where(f"org_bucket <> {bucket}").count() == 0


def test_empty_batches(spark, table):
    table.merge(frame(spark, []), 0)
    table.merge(frame(spark, [row(1, "a", "2001-01-05")]), 1)
    table.merge(frame(spark, []), 2)
    assert len(kept(table)) == 1


def test_buckets_follow_the_input():
    assert [buckets_for(b) for b in (0, 1 << 30, 1 << 40, 100 << 40)] == [1, 1, 64, 1024]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def books(spark, small):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # plans with all pushed filters
    return Books(spark, small, stored=True)


def test_stored_equals_computed(books):
    columns = schemas.LEDGER.names
    stored, computed = books.ledger.select(columns), books.computed_ledger.select(columns)
    assert stored.count() == computed.count()
    assert stored.exceptAll(computed).count() == 0


@pytest.mark.parametrize("figure", ["net_profit", "expense_change", "drill_down", "monthly_series"])
def test_figures_read_only_their_months(books, figure):
    period = trailing_months(AS_OF, 12)
    df = {
        "net_profit": lambda: metrics.metric_table(books.ledger, period, ["net_profit"]),
        "expense_change": lambda: breakdowns.expense_change(books.ledger, month_period(2001, 7), month_period(2001, 6)),
        "drill_down": lambda: breakdowns.drill_down(books.ledger, period.start, period.end),
        "monthly_series": lambda: metrics.monthly_series(books.ledger, AS_OF, 12),
    }[figure]()
    text = plan(df)
    partition = text.split("PartitionFilters: [")[1].split("]")[0]
    pushed = text.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "occurred_month" in partition and ">=" in partition and "<=" in partition
    assert "EqualTo(is_canonical,true)" in pushed and "GreaterThanOrEqual(occurred_at" in pushed
    assert "merchant_name" not in text.split("ReadSchema")[1].split("\n")[0] or figure == "drill_down"
    assert "lineitem" not in text


def test_a_changed_table_is_read_anew(spark, small):
    folder = fresh_path(spark, "books")
    for name in ("lineitem", "part", "supplier", "orders", "customer"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    before = Books(spark, folder, stored=True).ledger.count()
    assert Books(spark, folder, stored=True).ledger_table.path == Books(spark, folder, stored=True).ledger_table.path
    spark.read.parquet(f"{small}/orders.parquet").limit(10).write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    assert Books(spark, folder, stored=True).ledger.count() < before
