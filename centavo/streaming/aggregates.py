"""Totals kept up to date by a change stream: mergeable sums, replaced a partition at a time.

A table holds one row of sums per key and period, partitioned by the period. A batch of changes becomes one
delta per key and period; only the partitions of those periods are read, added to and replaced,
so the others keep their files and the history is not read again. A row taken back counts with sign -1.

Each partition carries the batch that replaced it last. A batch that runs again after a crash leaves out the
partitions it has already replaced, so no delta is added twice, whichever partitions the first attempt got to.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centavo.functions.money import minor
from centavo.functions.periods import month_start
from centavo.operators.predicates import analytical
from centavo.session import written

BATCH = "batch_id"


@dataclass(frozen=True)
class MergedTotals:
    """A stored table of sums: `keys` and `sums` within each `period` (a date)."""

    spark: SparkSession
    path: str
    keys: T.StructType
    period: str
    sums: Sequence[str]

    @property
    def schema(self) -> T.StructType:
        more = [T.StructField(s, T.LongType()) for s in self.sums]
        return T.StructType([*self.keys.fields, *more, T.StructField(BATCH, T.LongType()), T.StructField(self.period, T.DateType())])

    def read(self, *periods) -> DataFrame:
        """All totals, or those of some periods; keys whose every change was taken back have sums of nought."""
        try:
            rows = self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], self.schema)
        return rows.where(F.col(self.period).isin(*periods)) if periods else rows

    def apply(self, deltas: DataFrame, batch_id: int) -> list:
        """Add a batch's deltas (keys, period, sums). Returns the periods it touched."""
        names = [*self.keys.names, self.period]
        totals = [F.sum(s).cast("bigint").alias(s) for s in self.sums]
        fresh = written(deltas.where(F.col(self.period).isNotNull()).groupBy(*names).agg(*totals), "deltas")
        touched = [r[0] for r in fresh.select(self.period).distinct().collect()]  # calendar periods
        if not touched:
            return []
        stored = self.read(*touched)
        done = [r[0] for r in stored.where(F.col(BATCH) >= batch_id).select(self.period).distinct().collect()]
        todo = [p for p in touched if p not in done]
        if todo:
            both = fresh.select(*names, *self.sums).unionByName(stored.select(*names, *self.sums)).where(F.col(self.period).isin(*todo))
            merged = written(both.groupBy(*names).agg(*totals).withColumn(BATCH, F.lit(batch_id).cast("bigint")), "totals")
            (
                merged.select(self.schema.names)
                .repartition(self.period)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(self.period)
                .parquet(self.path)
            )
        return touched


CLASS_KEYS = T.StructType([T.StructField("org_id", T.IntegerType()), T.StructField("statement", T.StringType())])


def class_totals(spark: SparkSession, path: str) -> MergedTotals:
    """Sum and number of rows of each statement class per tenant and month."""
    return MergedTotals(spark, path, CLASS_KEYS, "month", ("total_minor", "n"))


def class_deltas(changes: DataFrame) -> DataFrame:
    """`changes`: ledger rows with `sign`, 1 for a row added and -1 for one taken back."""
    return (
        analytical(changes)
        .groupBy("org_id", "statement", month_start(F.col("occurred_at")).alias("month"))
        .agg(F.sum(F.col("sign") * minor("amount")).alias("total_minor"), F.sum("sign").alias("n"))
    )


def keep_class_totals(path: str) -> Callable[[DataFrame, int], None]:
    """Batch function of a change stream."""

    def run(batch: DataFrame, batch_id: int) -> None:
        class_totals(batch.sparkSession, path).apply(class_deltas(batch), batch_id)

    return run


def monthly_profit(totals: DataFrame) -> DataFrame:
    """Monthly profit and loss of every tenant from its class totals."""

    def total(*statements: str):
        return F.coalesce(F.sum(F.when(F.col("statement").isin(*statements), F.col("total_minor"))), F.lit(0)).cast("bigint")

    rows = totals.where("n <> 0").groupBy("org_id", "month").agg(
        total("revenue").alias("revenue_minor"), total("cogs").alias("cogs_minor"), total("opex", "payroll").alias("opex_minor"), F.sum("n").alias("n")
    )
    return rows.withColumn("profit_minor", F.col("revenue_minor") - F.col("cogs_minor") - F.col("opex_minor"))


ACCESS_KEYS = T.StructType([T.StructField("user_id", T.LongType())])


def access_totals(spark: SparkSession, path: str) -> MergedTotals:
    """Reads per user and day."""
    return MergedTotals(spark, path, ACCESS_KEYS, "day", ("n",))


def keep_access_anomalies(target: str, days: int = 7) -> Callable[[DataFrame, int], None]:
    """Batch function of a stream of reads (`user_id, day`): daily counts, and anew the anomalies of the days they bear on.

    A count bears on its own day and the `days` after it; only those and the `days` before them are read. Days judged
    again by a later batch, late reads included, are answered by that one (see `access_anomalies`).
    """
    from centavo.operators.insights import unusual_days

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        totals = access_totals(spark, f"{target}/daily")
        touched = totals.apply(batch.where("user_id IS NOT NULL").groupBy("user_id", "day").agg(F.count("*").alias("n")), batch_id)
        moved = spark.createDataFrame([(d,) for d in touched], "touched date")
        judged = moved.select(F.explode(F.sequence("touched", F.date_add("touched", days))).alias("day")).distinct()
        needed = [r.day for r in moved.select(F.explode(F.sequence(F.date_sub("touched", days), F.date_add("touched", days))).alias("day")).distinct().collect()]
        daily = totals.read(*needed).select("user_id", "day", "n") if needed else totals.read().limit(0).select("user_id", "day", "n")
        found = unusual_days(daily, days).join(F.broadcast(judged), "day", "left_semi")  # a row per calendar day
        found.write.mode("overwrite").parquet(f"{target}/found/batch_id={batch_id}")
        judged.write.mode("overwrite").parquet(f"{target}/judged/batch_id={batch_id}")

    return run


def access_anomalies(spark: SparkSession, target: str) -> DataFrame:
    """Anomalies of every day as the last batch that judged it found them."""
    last = spark.read.parquet(f"{target}/judged").groupBy("day").agg(F.max(BATCH).alias(BATCH))
    return spark.read.parquet(f"{target}/found").join(last, ["day", BATCH], "left_semi").drop(BATCH)
