"""Snapshot tables: metrics and forecasts kept with the version that computed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_PARTITIONS = ("metric_key", "period_start", "engine_version")


def write_metric_snapshots(metrics: DataFrame, path: str) -> None:
    """Replace the (metric, period, version) partitions present in `metrics`; leave the rest."""
    (
        metrics.repartition(*METRIC_PARTITIONS, F.pmod(F.xxhash64("org_id"), F.lit(16)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*METRIC_PARTITIONS)
        .parquet(path)
    )


def read_metric_snapshots(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def append_forecasts(snapshot: DataFrame, path: str) -> None:
    """Append one row per tenant; earlier forecasts stay for scoring."""
    snapshot.write.mode("append").partitionBy("as_of").parquet(path)


def latest_forecasts(spark: SparkSession, path: str) -> DataFrame:
    from centavo.operators.versions import latest_by

    return latest_by(spark.read.parquet(path), ["org_id"], [F.col("as_of").desc()])
