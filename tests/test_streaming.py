"""Landing, replay after a crash, late events."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from centavo.session import fresh_path
from centavo.sources import landing
from centavo.streaming import events, ingest, invalidation
from tests.test_metrics import ledger, row
from tests.test_normalize import PAGE, page


def run(spark, base):
    ingest.backfill(spark, f"{base}/landing", f"{base}/pages", f"{base}/checkpoint").awaitTermination()
    return sorted((r.record_type, r.page_index, r.record_count) for r in ingest.read_index(spark, f"{base}/pages").collect())


def land(spark, base, *pages):
    landing.write_pages(spark.createDataFrame(list(pages), PAGE), f"{base}/landing")


def test_backfill_resumes_and_keeps_each_page_once(spark):
    base = fresh_path(spark, "t")
    first = page("Item", [{"Id": "1"}, {"Id": "2"}], 0)
    land(spark, base, first, page("Bill", [{"Id": "1"}], 0))
    assert run(spark, base) == [("Bill", 0, 1), ("Item", 0, 2)]
    land(spark, base, page("Item", [{"Id": "1"}, {"Id": "2"}], 0, dt.datetime(2001, 7, 9), "later"), page("Item", [{"Id": "3"}], 1))
    want = [("Bill", 0, 1), ("Item", 0, 2), ("Item", 1, 1)]
    assert run(spark, base) == want
    assert run(spark, base) == want
    # A page older than everything archived is kept, one seen long ago is not archived again.
    land(spark, base, page("Item", [{"Id": "0"}], 7, dt.datetime(1999, 5, 1)))
    want = sorted([*want, ("Item", 7, 1)])
    assert run(spark, base) == want
    land(spark, base, page("Item", [{"Id": "1"}, {"Id": "2"}], 0, dt.datetime(2003, 7, 9), "much later"))
    assert run(spark, base) == want


def test_batch_that_runs_again_after_a_crash_changes_nothing(spark):
    base = fresh_path(spark, "t")
    land(spark, base, page("Item", [{"Id": "1"}], 0))
    run(spark, base)
    land(spark, base, page("Item", [{"Id": "2"}], 1))
    want = run(spark, base)
    commits = sorted(glob.glob(f"{base}/checkpoint/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    last = commits[-1]
    os.replace(last, f"{base}/uncommitted")
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.replace(crc, f"{base}/uncommitted.crc")
    assert run(spark, base) == want


def test_current_records_follow_edits(spark):
    base = fresh_path(spark, "t")
    land(spark, base, page("Invoice", [{"Id": "1", "n": 1, "MetaData": {"LastUpdatedTime": "2001-07-01T00:00:00Z"}}], 0))
    run(spark, base)
    land(spark, base, page("Invoice", [{"Id": "1", "n": 2, "MetaData": {"LastUpdatedTime": "2001-07-02T00:00:00Z"}}], 5, dt.datetime(2001, 7, 3)))
    run(spark, base)
    rows = ingest.current_records(spark, f"{base}/pages").select(F.try_variant_get("record", "$.n", "int").alias("n"))
    assert [r.n for r in rows.collect()] == [2]


def test_landing_is_pruned_by_tenant(spark):
    base = fresh_path(spark, "t")
    land(spark, base, page("Item", [{"Id": "1"}], org=1), page("Item", [{"Id": "1"}], org=2))
    df = landing.read_pages(spark, f"{base}/landing").where("org_id = 2")
    assert df.count() == 1
    assert "PartitionFilters: [isnotnull(org_id" in df._jdf.queryExecution().executedPlan().toString()


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def test_session_stream_agrees_with_batch(spark, small):
    table = spark.read.parquet(f"{small}/events.parquet")
    base = fresh_path(spark, "t")
    table.orderBy(F.md5(F.col("event_id").cast("string").cast("binary"))).repartition(4).write.parquet(f"{base}/in")
    stream = events.event_stream(spark, f"{base}/in")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    query = (
        events.session_stream(stream, "30 minutes", "60 days")
        .writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.where(F.col("batch_id") == out.agg(F.max("batch_id")).first()[0])
    batch = events.sessions(table.withColumn("ts", F.col("ts").cast("timestamp")))
    columns = ["user_id", "started_at", "ended_at", "n", "errors"]
    assert sorted(map(tuple, last.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))


def test_rates_of_a_folder_in_any_order(spark, small):
    table = spark.read.parquet(f"{small}/events.parquet")
    base = fresh_path(spark, "t")
    table.orderBy(F.desc("ts")).coalesce(1).limit(50).write.parquet(f"{base}/events.parquet")
    table.orderBy("ts").limit(50).coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
    out = events.rates(events.event_stream(spark, f"{base}/events.parquet"))
    name = "rates_" + base[-8:]
    stream = out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{base}/c")
    stream.trigger(availableNow=True).start().awaitTermination()
    assert spark.table(name).agg(F.sum("n")).first()[0] == 100


def test_only_touched_months_are_recomputed(spark):
    books = ledger(spark, [row(day=dt.date(2001, m, 3), amount=str(m)) for m in range(1, 8)])
    change = ledger(spark, [row(day=dt.date(2001, 5, 9), posted=dt.date(2001, 6, 2))])
    touched = invalidation.touched_months(change)
    assert sorted(r.month.month for r in touched.collect()) == [5, 6]
    got = {r.month.month: r.opex_minor for r in invalidation.recompute(books, touched).collect()}
    assert got == {5: 500, 6: 600}
    written = []
    invalidation.refresh_on_change(lambda: books, lambda df, i: written.append((i, df.count())))(change, 3)
    assert written == [(3, 2)]
