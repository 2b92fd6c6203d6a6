"""Product events: sessions, rates and windows, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of a table, be it one file or a folder of part files."""
    either = f"{path[:-1]}[{path[-1]}]"  # as a pattern, the path may name a file as well as a folder
    rows = spark.readStream.schema(EVENT_SCHEMA).parquet(either)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _session_counts() -> list:
    return [
        F.count("*").alias("n"),
        F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"),
    ]


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Per-user sessions of a stream, closed by inactivity."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(*_session_counts())
        .select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n", "errors")
    )


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Per-user sessions of a finished table.

    Events in one slice no longer than the gap always share a session, so they
    are first reduced per (user, slice). Only slices, a bounded number per user
    however many events one user has, are ordered in a window.
    """
    gap = gap_minutes * 60_000_000
    micros = F.unix_micros("ts")
    slices = events.groupBy("user_id", F.floor(micros / F.lit(gap)).alias("slice")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *_session_counts()
    )
    per_user = Window.partitionBy("user_id").orderBy("slice")
    idle = F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(per_user))
    numbered = slices.withColumn("opens", F.when(idle < gap, 0).otherwise(1)).withColumn(
        "session_no", F.sum("opens").over(per_user)
    )
    return (
        numbered.groupBy("user_id", "session_no")
        .agg(
            F.min("first_ts").alias("started_at"),
            (F.max("last_ts") + F.make_dt_interval(mins=F.lit(gap_minutes))).alias("ended_at"),
            F.sum("n").alias("n"),
            F.sum("errors").alias("errors"),
        )
        .drop("session_no")
    )


def rates(events: DataFrame, window: str = "1 day", late: str | None = None) -> DataFrame:
    """Events and distinct types per tumbling window; counts only, so state stays small."""
    rows = events if late is None else events.withWatermark("ts", late)
    return (
        rows.groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n")
    )
