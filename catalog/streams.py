"""Streaming jobs run to completion over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog import raw_books
from catalog.insights import ACCESS_SQL
from catalog.metrics import SERIES, SERIES_OUT
from catalog.registry import query
from centavo.functions.money import minor
from centavo.operators import normalize as nz
from centavo.session import fresh_path
from centavo.sources import landing
from centavo.sources.ledger import LAYOUT
from centavo.streaming import aggregates, events, ingest, invalidation, sessions


@query(
    "stream_backfill",
    "S-1",
    "S-5",
    "T-1",
    "T-2",
    sql="""WITH p AS (SELECT CAST(c_custkey % 25 AS INT) AS org_id, c_custkey // 500 AS page, COUNT(*) AS n FROM customer GROUP BY 1, 2)
SELECT org_id, 'Customer' AS record_type, COUNT(*) AS pages, CAST(SUM(n) AS BIGINT) AS records FROM p GROUP BY 1""",
    views=False,
)
def stream_backfill(b):
    """Land pages, run, land the retries of a crash, resume: every page is archived once."""
    base = fresh_path(b.spark, "backfill")
    first = raw_books.to_pages(raw_books.customer_records(b), raw_books.FIRST_FETCH)
    landing.write_pages(first, f"{base}/landing")
    ingest.backfill(b.spark, f"{base}/landing", f"{base}/pages", f"{base}/checkpoint").awaitTermination()
    again = raw_books.refetched(first, raw_books.SECOND_FETCH)
    landing.write_pages(again, f"{base}/landing")
    ingest.backfill(b.spark, f"{base}/landing", f"{base}/pages", f"{base}/checkpoint").awaitTermination()
    return (
        ingest.read_index(b.spark, f"{base}/pages")
        .groupBy("org_id", "record_type")
        .agg(F.count("*").alias("pages"), F.sum("record_count").cast("bigint").alias("records"))
    )


@query(
    "stream_keep_latest",
    "T-3",
    "N-14",
    sql="""SELECT CAST(o_custkey % 25 AS INT) AS org_id, COUNT(*) AS n, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'P' THEN CAST(ROUND(CAST(o_totalprice AS DECIMAL(20,6)) * 0.5, 2) * 100 AS BIGINT)
ELSE CAST(ROUND(o_totalprice * 100) AS BIGINT) END) AS BIGINT) AS balance_minor FROM orders WHERE o_orderkey % 503 <> 9 GROUP BY 1""",
    views=False,
)
def stream_keep_latest(b):
    """Later versions of invoices arrive in a second run and replace the first ones."""
    base = fresh_path(b.spark, "latest")
    for records, fetched, offset in (
        (raw_books.invoice_records(b), raw_books.FIRST_FETCH, 0),
        (raw_books.invoice_edits(b), raw_books.SECOND_FETCH, 1_000_000),
    ):
        landing.write_pages(raw_books.to_pages(records, fetched, offset), f"{base}/landing")
        ingest.backfill(b.spark, f"{base}/landing", f"{base}/pages", f"{base}/checkpoint").awaitTermination()
    rows = ingest.current_records(b.spark, f"{base}/pages").where(nz.text("Id").isNotNull())
    return rows.groupBy("org_id").agg(
        F.count("*").alias("n"), F.sum(minor(nz.amount("Balance"))).alias("balance_minor")
    )


@query(
    "change_sweep",
    "T-4",
    sql="""WITH k AS (SELECT CAST(o_custkey % 25 AS INT) AS org_id, o_orderkey % 503 <> 9 AS named FROM orders)
SELECT org_id, COUNT(CASE WHEN named THEN 1 END) AS our_count, COUNT(*) AS provider_count, COUNT(CASE WHEN NOT named THEN 1 END) > 0 AS divergent FROM k GROUP BY 1""",
    views=False,
)
def change_sweep(b):
    """Changes arrive by stream; a scheduled count against the provider finds what differs.

    Edits do not count twice: ours are the distinct live ids. Records that came without an id are missing here.
    """
    from centavo.operators.quality import reconcile

    base = fresh_path(b.spark, "sweep")
    landing.write_pages(raw_books.pages(b, "Invoice"), f"{base}/landing")
    ingest.backfill(b.spark, f"{base}/landing", f"{base}/pages", f"{base}/checkpoint").awaitTermination()
    live = ingest.current_records(b.spark, f"{base}/pages").where(nz.text("Id").isNotNull())
    ours = live.groupBy("org_id").agg(F.count("*").alias("n"))
    provider = b.table("orders").groupBy((F.col("o_custkey") % 25).cast("int").alias("org_id")).agg(F.count("*").alias("n"))
    return reconcile(ours, provider, ["org_id"])


@query(
    "touched_months",
    "T-5",
    sql="""SELECT DISTINCT org_id, CAST(date_trunc('month', d) AS DATE) AS month FROM (SELECT org_id, UNNEST([occurred_at, posted_at]) AS d FROM ledger_c WHERE occurred_at >= DATE '2001-07-20') x WHERE d IS NOT NULL""",
)
def touched_months(b):
    changes = b.ledger.where(F.col("occurred_at") >= F.lit(dt.date(2001, 7, 20)))
    return invalidation.touched_months(changes)


@query(
    "recomputed_months",
    "T-5",
    sql=""", hit AS (SELECT DISTINCT org_id, CAST(date_trunc('month', d) AS DATE) AS month FROM (SELECT org_id, UNNEST([occurred_at, posted_at]) AS d FROM ledger_c WHERE occurred_at >= DATE '2001-07-20') x WHERE d IS NOT NULL),
s AS ("""
    + SERIES.format(
        bucket="CAST(date_trunc('month', occurred_at) AS DATE) AS month",
        where="(org_id, CAST(date_trunc('month', occurred_at) AS DATE)) IN (SELECT (org_id, month) FROM hit)",
    )
    + ")\n"
    + SERIES_OUT,
)
def recomputed_months(b):
    changes = b.ledger.where(F.col("occurred_at") >= F.lit(dt.date(2001, 7, 20)))
    return invalidation.recompute(b.ledger, invalidation.touched_months(changes))


def landed(b, rows, base: str, schema, sink) -> None:
    """Land rows in a folder and run its stream until it is read; progress is the checkpoint."""
    rows.write.mode("append").parquet(f"{base}/landing")
    stream = b.spark.readStream.schema(schema).parquet(f"{base}/landing")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@query(
    "incremental_profit",
    "T-5",
    "S-12",
    sql=""", s AS (SELECT org_id, CAST(date_trunc('month', occurred_at) AS DATE) AS month, statement, minor + CASE WHEN occurred_at BETWEEN DATE '2001-05-01' AND DATE '2001-05-31' AND minor % 10 = 0 THEN 100 ELSE 0 END AS m FROM base)
SELECT org_id, month, CAST(COALESCE(SUM(CASE WHEN statement = 'revenue' THEN m END), 0) AS BIGINT) AS revenue_minor, CAST(COALESCE(SUM(CASE WHEN statement = 'cogs' THEN m END), 0) AS BIGINT) AS cogs_minor,
CAST(COALESCE(SUM(CASE WHEN statement IN ('opex', 'payroll') THEN m END), 0) AS BIGINT) AS opex_minor, COUNT(*) AS n,
CAST(COALESCE(SUM(CASE WHEN statement = 'revenue' THEN m WHEN statement IN ('cogs', 'opex', 'payroll') THEN -m END), 0) AS BIGINT) AS profit_minor FROM s GROUP BY 1, 2""",
)
def incremental_profit(b):
    """Two batches of changes: the books to June; then July on, with some amounts of May put right."""
    base = fresh_path(b.spark, "incremental")
    sink = aggregates.keep_class_totals(f"{base}/totals")
    july = F.lit(dt.date(2001, 7, 1))
    rows = b.ledger.drop(*LAYOUT).withColumn("sign", F.lit(1))
    wrong = rows.where(F.col("occurred_at").between(F.lit(dt.date(2001, 5, 1)), F.lit(dt.date(2001, 5, 31))) & (minor("amount") % 10 == 0))
    right = wrong.withColumn("amount", (F.col("amount") + 1).cast("decimal(20,4)"))
    second = rows.where(F.col("occurred_at") >= july).unionByName(wrong.withColumn("sign", F.lit(-1))).unionByName(right)
    for changes in (rows.where(F.col("occurred_at") < july), second):
        landed(b, changes, base, rows.schema, sink)
    return aggregates.monthly_profit(aggregates.class_totals(b.spark, f"{base}/totals").read())


SESSIONS_SQL = """WITH g AS (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, MIN(ts) AS started_at, MAX(ts) + INTERVAL 30 MINUTE AS ended_at, COUNT(*) AS n, COUNT(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM s GROUP BY user_id, sid"""


def session_store(b):
    """The events land in four parts by time; each fiftieth comes one part later than it should."""
    base = fresh_path(b.spark, "sessions")
    store = sessions.SessionStore(b.spark, f"{base}/out")
    rows = b.table("events").withColumn("ts", F.col("ts").cast("timestamp")).select(sessions.STORED_EVENT.names)
    low, high = rows.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    part = F.floor((F.unix_seconds("ts") - low) * 4 / (high - low + 1)) + (F.col("event_id") % 50 == 0).cast("int")
    for k in range(4):
        landed(b, rows.where(F.least(part, F.lit(3)) == k), base, sessions.STORED_EVENT, sessions.session_sink(store))
    return store


@query("stream_sessions", "T-6", sql=SESSIONS_SQL, views=False)
def stream_sessions(b):
    """Sessions of the stream together with the events that came too late for it."""
    return session_store(b).with_late()


@query(
    "late_events",
    "T-6",
    sql="""WITH b AS (SELECT MIN(epoch(date_trunc('second', ts))) AS low, MAX(epoch(date_trunc('second', ts))) AS high FROM events),
p AS (SELECT event_id, user_id, ts, CAST(LEAST(3, FLOOR((epoch(date_trunc('second', ts)) - low) * 4 / (high - low + 1)) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS part FROM events, b),
m AS (SELECT part, MAX(MAX(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM p GROUP BY part)
SELECT event_id, user_id, ts, part AS batch_id FROM p JOIN m USING (part) WHERE ts < newest - INTERVAL 1 HOUR""",
    views=False,
)
def late_events(b):
    return session_store(b).late().select("event_id", "user_id", "ts", "batch_id")


@query(
    "event_sessions",
    "T-6",
    sql=SESSIONS_SQL,
    views=False,
)
def event_sessions(b):
    rows = b.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(rows)


@query(
    "stream_event_rates",
    "T-6",
    sql="SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2",
    views=False,
)
def stream_event_rates(b):
    """Daily counts kept up to date by a stream; each batch writes the windows it changed."""
    base = fresh_path(b.spark, "rates")

    def write(batch, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    # No lateness is declared for the table, so no row may be late: the state is one count per day and type.
    counted = events.rates(events.event_stream(b.spark, f"{b.path}/events.parquet"))
    (
        counted.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    from centavo.operators.versions import latest_by

    rows = b.spark.read.parquet(f"{base}/out")
    return latest_by(rows, ["window_start", "event_type"], [F.col("batch_id").desc()]).drop("batch_id")


@query("stream_access_anomalies", "A-51", sql=ACCESS_SQL, views=False)
def stream_access_anomalies(b):
    """Reads arrive in two parts, some of the first with the second; days are judged again as reads for them come."""
    base = fresh_path(b.spark, "access")
    rows = b.table("events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    middle = rows.agg(F.percentile_approx(F.unix_date("day"), 0.5)).first()[0]
    second = (F.unix_date("day") > middle) | (F.col("event_id") % 50 == 0)
    for part in (rows.where(~second), rows.where(second)):
        landed(b, part, base, rows.schema, aggregates.keep_access_anomalies(f"{base}/out"))
    return aggregates.access_anomalies(b.spark, f"{base}/out")


@query(
    "event_field_coverage",
    "A-21",
    sql="""SELECT event_type, 'k' AS field, COUNT(*) AS n, CAST(100 AS DOUBLE) AS coverage_pct FROM events GROUP BY 1""",
    views=False,
)
def event_field_coverage(b):
    from centavo.operators.quality import field_coverage

    rows = b.table("events").select("event_type", F.parse_json("props").alias("record"))
    return field_coverage(rows, ["event_type"])
