"""Product analytics on the event table: funnel, retention, cohorts, rates, traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centavo.functions.money import round_half_up


def funnel(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Users reaching each step in order, and conversion from the step before.

    Each user is reduced to the first time of every step; a step counts when its
    first time is not before that of the step ahead of it.
    """
    first = events.groupBy("user_id").agg(
        *[F.min(F.when(F.col("event_type") == s, F.col("ts"))).alias(f"t{i}") for i, s in enumerate(steps)]
    )
    reached = [F.col("t0").isNotNull()]
    for i in range(1, len(steps)):
        reached.append(reached[-1] & F.coalesce(F.col(f"t{i}") >= F.col(f"t{i - 1}"), F.lit(False)))
    counts = first.agg(*[F.count(F.when(r, 1)).alias(f"n{i}") for i, r in enumerate(reached)])
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step_no"),
                F.lit(s).alias("step"),
                F.col(f"n{i}").alias("users"),
                _rate(F.col(f"n{i}"), F.col(f"n{max(i - 1, 0)}")).alias("conversion"),
            )
            for i, s in enumerate(steps)
        ]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round_half_up(part.cast("double") / whole.cast("double"), 4))


def user_weeks(events: DataFrame) -> DataFrame:
    """Distinct (user, week since first event)."""
    days = events.select("user_id", F.to_date("ts").alias("day")).distinct()
    first = days.groupBy("user_id").agg(F.min("day").alias("first_day"))
    week = F.floor(F.datediff(F.col("day"), F.col("first_day")) / 7).cast("int")
    return days.join(first, "user_id").select("user_id", "first_day", week.alias("week_no")).distinct()


def cohorts(events: DataFrame) -> DataFrame:
    """Active users per first-event week and week since."""
    return (
        user_weeks(events)
        .groupBy(F.trunc("first_day", "week").alias("cohort"), "week_no")
        .agg(F.count("*").alias("users"))
    )


def week_retention(events: DataFrame, week: int = 4) -> DataFrame:
    """Share of users active in the n-th week after their first event (week 1 is the first)."""
    weeks = user_weeks(events)
    return weeks.agg(
        F.count(F.when(F.col("week_no") == 0, 1)).alias("users"),
        F.count(F.when(F.col("week_no") == week - 1, 1)).alias("active"),
    ).withColumn("retention", _rate(F.col("active"), F.col("users")))


def weekly_rates(events: DataFrame, part: str, whole: str, limit: float) -> DataFrame:
    """Weekly ratio of one event type to another, flagged above a limit."""
    weekly = events.groupBy(F.trunc(F.to_date("ts"), "week").alias("week")).agg(
        F.count(F.when(F.col("event_type") == part, 1)).alias("part_n"),
        F.count(F.when(F.col("event_type") == whole, 1)).alias("whole_n"),
    )
    return weekly.withColumn("rate", _rate(F.col("part_n"), F.col("whole_n"))).withColumn(
        "above_limit", F.col("rate") > limit
    )


def trace_rollup(traces: DataFrame) -> DataFrame:
    """Answers, violations, latency and cost per prompt version.

    `traces`: `prompt_version, grounding_violations, latency_ms, cost_minor`.
    Latency is an integer, so exact percentiles keep one counter per distinct value.
    """
    grouped = traces.groupBy("prompt_version").agg(
        F.count("*").alias("answers"),
        F.sum("grounding_violations").cast("bigint").alias("violations"),
        F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95))).alias("p"),
        F.sum("cost_minor").alias("cost_minor"),
    )
    return grouped.select(
        "prompt_version",
        "answers",
        "violations",
        F.round(F.col("p")[0], 4).alias("latency_p50"),
        F.round(F.col("p")[1], 4).alias("latency_p95"),
        "cost_minor",
    )
