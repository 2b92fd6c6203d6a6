"""Sessions of an event stream, with the rows that came too late kept beside them.

A batch reduces its events per user and slice of time, merges them with the sessions still open and closes
those that no event in time can reach any more. An event is late when it is older than the newest event of earlier
batches less the allowed lateness. It changes no session of the stream and is not dropped: it
goes to a side output, from which `with_late` gives the sessions of all events.

Every output of a batch is a folder of its own, named by the batch, and is made from that batch's rows and the outputs
of the batch before. A batch that runs again after a crash replaces its folders and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centavo.session import written
from centavo.streaming.events import EVENT_SCHEMA

SESSION = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("ended_at", T.TimestampType()),
        T.StructField("n", T.LongType()),
        T.StructField("errors", T.LongType()),
    ]
)
STORED_EVENT = T.StructType([T.StructField(f.name, T.TimestampType() if f.name == "ts" else f.dataType) for f in EVENT_SCHEMA])


def short_sessions(events: DataFrame, gap_minutes: int) -> DataFrame:
    """Sessions of the events in one slice no longer than the gap: they always belong together."""
    at = F.floor(F.unix_micros("ts") / F.lit(gap_minutes * 60_000_000))
    counts = [F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")]
    slices = events.groupBy("user_id", at.alias("slice")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("last"), *counts)
    ended = (F.col("last") + F.make_dt_interval(mins=F.lit(gap_minutes))).alias("ended_at")
    return slices.select("user_id", "started_at", ended, "n", "errors")


def merged_sessions(parts: DataFrame) -> DataFrame:
    """Sessions that overlap become one. The window runs over parts, a bounded number per user and day."""
    before = Window.partitionBy("user_id").orderBy("started_at", "ended_at").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.max("ended_at").over(before)
    opens = F.when(F.col("started_at") < reached, 0).otherwise(1)
    numbered = parts.withColumn("opens", opens).withColumn("number", F.sum("opens").over(upto))
    return (
        numbered.groupBy("user_id", "number")
        .agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.sum("n").alias("n"), F.sum("errors").alias("errors"))
        .drop("number")
    )


@dataclass(frozen=True)
class SessionStore:
    """Folders `closed`, `open`, `late` and `progress` under `target`, each with one part per batch."""

    spark: SparkSession
    target: str
    gap_minutes: int = 30
    late_minutes: int = 60

    def _read(self, name: str, schema: T.StructType, batch_id: int | None = None) -> DataFrame:
        """All parts of an output with their `batch_id`, or the part of one batch; empty if there is none."""
        path = f"{self.target}/{name}" + ("" if batch_id is None else f"/batch_id={batch_id}")
        full = schema if batch_id is not None else T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        try:
            return self.spark.read.schema(full).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], full)

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.target}/{name}/batch_id={batch_id}")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        progress = T.StructType([T.StructField("newest", T.TimestampType())])
        events = written(batch.select(STORED_EVENT.names), "events")
        before = self._read("progress", progress, batch_id - 1).first()
        allowed = F.make_dt_interval(mins=F.lit(self.late_minutes))
        newest = F.lit(before.newest if before else None).cast("timestamp")
        late = F.col("ts").isNull() | F.coalesce(F.col("ts") < newest - allowed, F.lit(False))
        self._write(events.where(late), "late", batch_id)
        parts = short_sessions(events.where(~late), self.gap_minutes).unionByName(self._read("open", SESSION, batch_id - 1))
        now = events.agg(F.greatest(F.max("ts"), newest).alias("newest"))
        self._write(now, "progress", batch_id)
        reach = F.lit(self._read("progress", progress, batch_id).first().newest).cast("timestamp") - allowed
        sessions = written(merged_sessions(parts), "sessions")
        over = F.coalesce(F.col("ended_at") <= reach, F.lit(False))
        self._write(sessions.where(over), "closed", batch_id)
        self._write(sessions.where(~over), "open", batch_id)

    def sessions(self) -> DataFrame:
        """Closed sessions, and those still open after the last batch."""
        last = self._read("progress", T.StructType([])).agg(F.max("batch_id")).first()[0]
        closed = self._read("closed", SESSION).drop("batch_id")
        return closed if last is None else closed.unionByName(self._read("open", SESSION, last))

    def late(self) -> DataFrame:
        """Events that came too late, and events without a time, with the batch they came in."""
        return self._read("late", STORED_EVENT)

    def with_late(self) -> DataFrame:
        """The sessions of all events, those that came late included."""
        parts = short_sessions(self.late().where("ts IS NOT NULL"), self.gap_minutes)
        return merged_sessions(self.sessions().unionByName(parts))


def session_sink(store: SessionStore) -> Callable[[DataFrame, int], None]:
    """Batch function of an event stream."""

    def run(batch: DataFrame, batch_id: int) -> None:
        SessionStore(batch.sparkSession, store.target, store.gap_minutes, store.late_minutes).write(batch, batch_id)

    return run
