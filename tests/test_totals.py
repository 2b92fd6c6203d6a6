"""Totals and sessions kept by streams: replay, late rows, untouched files, against recomputation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from centavo.operators import insights
from centavo.session import fresh_path
from centavo.streaming import aggregates, sessions

CHANGE = "org_id int, statement string, amount decimal(20,4), occurred_at date, is_canonical boolean, is_transfer boolean, is_voided boolean, sign int"


def changes(spark, rows):
    """rows: org, statement, amount in cents, day, sign."""
    full = [(o, s, m, dt.date.fromisoformat(d), True, False, False, g) for o, s, m, d, g in rows]
    frame = spark.createDataFrame(full, CHANGE.replace("decimal(20,4)", "bigint"))
    return frame.withColumn("amount", (F.col("amount") / 100).cast("decimal(20,4)"))


def told(totals):
    return sorted((r.org_id, r.statement, str(r.month)[:7], r.total_minor, r.n) for r in totals.read().where("n <> 0").collect())


FIRST = [(1, "opex", 100, "2001-01-05", 1), (1, "opex", 50, "2001-01-09", 1), (2, "revenue", 70, "2001-01-09", 1), (1, "cogs", 5, "2001-02-09", 1)]
SECOND = [(1, "opex", 100, "2001-01-05", -1), (1, "opex", 130, "2001-01-05", 1), (1, "cogs", 5, "2001-02-09", -1), (3, "opex", 1, "2001-03-01", 1)]
AFTER = [(1, "opex", "2001-01", 180, 2), (2, "revenue", "2001-01", 70, 1), (3, "opex", "2001-03", 1, 1)]


def test_batches_and_replays(spark):
    path = fresh_path(spark, "totals-test")
    keep, totals = aggregates.keep_class_totals(path), aggregates.class_totals(spark, path)
    for batch_id, rows in ((0, FIRST), (0, FIRST), (1, SECOND), (1, SECOND)):
        keep(changes(spark, rows), batch_id)
    assert told(totals) == AFTER
    keep(changes(spark, FIRST).limit(0), 2)
    assert told(totals) == AFTER


def test_a_crash_between_partitions_adds_nothing_twice(spark):
    path = fresh_path(spark, "totals-test")
    keep, totals = aggregates.keep_class_totals(path), aggregates.class_totals(spark, path)
    keep(changes(spark, FIRST), 0)
    keep(changes(spark, [r for r in SECOND if r[3] < "2001-02"]), 1)  # the first attempt got as far as January
    keep(changes(spark, SECOND), 1)
    assert told(totals) == AFTER


def test_untouched_months_keep_their_files(spark):
    path = fresh_path(spark, "totals-test")
    keep, totals = aggregates.keep_class_totals(path), aggregates.class_totals(spark, path)
    keep(changes(spark, FIRST), 0)
    before = {f for f in totals.read().inputFiles() if "month=2001-01" in f}
    keep(changes(spark, [(1, "opex", 9, "2001-02-01", 1)]), 1)
    after = set(totals.read().inputFiles())
    assert before and before <= after
    assert all("month=2001-02" in f for f in after - before)


READ = "user_id bigint, day date"


def test_access_anomalies_equal_the_batch_query(spark):
    rng = random.Random(2)
    d0 = dt.date(2001, 1, 1)
    rows = [(u, d0 + dt.timedelta(days=d)) for u in range(4) for d in range(30) for _ in range(rng.choice([1, 2, 2, 3, 12]))]
    rng.shuffle(rows)
    rows.sort(key=lambda r: (r[1] > dt.date(2001, 1, 16)) != (rng.random() < 0.05))
    parts = [rows[:150], rows[150:200], rows[200:]]
    target = fresh_path(spark, "access-test")
    keep = aggregates.keep_access_anomalies(target)
    for batch_id, part in enumerate(parts):
        for _ in range(2):
            keep(spark.createDataFrame(part, READ), batch_id)
    got = sorted(map(tuple, aggregates.access_anomalies(spark, target).select("user_id", "day", "n", "trailing_mean").collect()))
    want = sorted(map(tuple, insights.access_anomalies(spark.createDataFrame(rows, READ)).select("user_id", "day", "n", "trailing_mean").collect()))
    assert got == want != []


EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
T0 = dt.datetime(2001, 1, 1, 8)


def events(spark, rows):
    """rows: id, minute, user."""
    return spark.createDataFrame([(i, None if m is None else T0 + dt.timedelta(minutes=m), u, "error" if i % 3 == 0 else "view", 0.0, None) for i, m, u in rows], EVENT)


def brute(rows, gap=30):
    out = []
    for user in {r[2] for r in rows}:
        held = None
        for i, m, _ in sorted((r for r in rows if r[2] == user and r[1] is not None), key=lambda r: r[1]):
            if held and m - held[2] < gap:
                held = [user, held[1], m, held[3] + 1, held[4] + (i % 3 == 0)]
            else:
                out += [held] if held else []
                held = [user, m, m, 1, int(i % 3 == 0)]
        out += [held] if held else []
    return sorted((u, b, e + gap, n, x) for u, b, e, n, x in out)


def minutes(frame):
    at = lambda t: int((t - T0).total_seconds() // 60)
    return sorted((r.user_id, at(r.started_at), at(r.ended_at), r.n, r.errors) for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_with_late_events_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(1500), rng.randrange(4)) for i in range(260)]
    parts = [[], [], [], []]
    for r in rows:
        parts[min(3, (r[1] + rng.choice([0, 0, 0, 0, 700])) // 400)].append(r)
    store = sessions.SessionStore(spark, fresh_path(spark, "sessions-test"))
    sink = sessions.session_sink(store)
    late, newest = [], None
    for batch_id, part in enumerate(parts):
        late += [(r[0], batch_id) for r in part if newest is not None and r[1] < newest - 60]
        newest = max([r[1] for r in part] + ([newest] if newest is not None else []))
        for _ in range(1 + (batch_id == 1)):  # a batch that runs again
            sink(events(spark, part), batch_id)
    assert sorted((r.event_id, r.batch_id) for r in store.late().collect()) == sorted(late) != []
    assert minutes(store.with_late()) == brute(rows)
    in_time = [r for r in rows if r[0] not in dict(late)]
    assert minutes(store.sessions()) == brute(in_time)


def test_empty_batches_and_events_without_a_time(spark):
    store = sessions.SessionStore(spark, fresh_path(spark, "sessions-test"))
    assert store.sessions().count() == 0
    sink = sessions.session_sink(store)
    sink(events(spark, [(1, 5, 1)]).limit(0), 0)
    sink(events(spark, [(1, 5, 1), (2, None, 1)]), 1)
    sink(events(spark, [(1, 5, 1)]).limit(0), 2)
    assert minutes(store.with_late()) == [(1, 5, 35, 1, 0)]
    assert [r.event_id for r in store.late().collect()] == [2]
