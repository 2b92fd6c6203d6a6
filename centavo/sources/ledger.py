"""The canonical ledger as a stored table.

Layout: month of `occurred_at`, bucket of the tenant, batch that brought the row; inside a file rows are ordered by
tenant and day. A reader that names days reads the months that hold them, one that names a tenant reads its
bucket, and inside a file the day, tenant and flag statistics skip row groups.

`merge` inserts the rows whose key is not there. A key is a tenant, source, record type and source id; a row
without a source id has no key and is always inserted, and a voided row does not hold its key. The keys are checked
against the four key columns of the tenants' buckets, so no other column and no other bucket is read. A
batch writes its own partitions only. If it runs again after a crash it does not see its own rows,
and replaces them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centavo.functions.periods import month_start
from centavo.operators.predicates import EARLIEST, LATEST, MONTH, occurred
from centavo.operators.versions import insert_absent
from centavo.session import written

KEYS = ("org_id", "source", "source_record_type", "source_txn_id")
BUCKET, BATCH = "org_bucket", "batch_id"
LAYOUT = (MONTH, BUCKET, BATCH)
BYTES_PER_BUCKET = 16 << 30
MOST_BUCKETS = 1024


def bucket_of(org_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(org_id.cast("bigint")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class LedgerTable:
    """A stored ledger. `schema` is that of its rows, without the layout columns."""

    spark: SparkSession
    path: str
    schema: T.StructType
    buckets: int = 1

    @property
    def stored_schema(self) -> T.StructType:
        layout = [T.StructField(MONTH, T.DateType()), T.StructField(BUCKET, T.IntegerType()), T.StructField(BATCH, T.LongType())]
        return T.StructType([*self.schema.fields, *layout])

    def read(self, start: dt.date | None = None, end: dt.date | None = None, orgs: Iterable[int] | None = None) -> DataFrame:
        """Rows that occurred from `start` to `end`, of some tenants; only their partitions are read."""
        rows = self.spark.read.schema(self.stored_schema).parquet(self.path)
        if start is not None or end is not None:
            rows = occurred(rows, start or EARLIEST, end or LATEST)
        if orgs is not None:
            named = sorted(set(orgs))
            buckets = [bucket_of(F.lit(o), self.buckets) for o in named]
            rows = rows.where(F.col("org_id").isin(named) & F.col(BUCKET).isin(*buckets)) if named else rows.where(F.lit(False))
        return rows

    def merge(self, rows: DataFrame, batch_id: int) -> None:
        """Insert the rows whose key is not there. Of rows of one key the first by day and amount is taken."""
        incoming = rows.select(*self.schema.names).withColumns({MONTH: month_start(F.col("occurred_at")), BUCKET: bucket_of(F.col("org_id"), self.buckets)})
        keyed = F.col("source_txn_id").isNotNull()
        order = [F.col("occurred_at"), F.col("amount")]
        there = self._present(incoming, batch_id)
        if there is None:  # the first batch meets nothing
            there = self.spark.createDataFrame([], T.StructType([*(self.schema[k] for k in KEYS), T.StructField("is_voided", T.BooleanType())]))
        added = insert_absent(there, incoming.where(keyed), list(KEYS), order).select(*incoming.columns)
        self._write(added.unionByName(incoming.where(~keyed)), batch_id)

    def load(self, rows: DataFrame, full: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        """Write rows whose keys are known to be distinct as the first batch of an empty table, without looking for them.

        `full` writes slim rows out to the columns of the table; the slim ones are shuffled. It keeps columns it does not know.
        """
        self._write(rows.withColumns({MONTH: month_start(F.col("occurred_at")), BUCKET: bucket_of(F.col("org_id"), self.buckets)}), 0, full)

    def _present(self, incoming: DataFrame, batch_id: int) -> DataFrame | None:
        """Keys of the buckets that the batch touches, other than its own; None if nothing was ever written."""
        try:
            stored = self.read()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        touched = [r[0] for r in incoming.select(BUCKET).distinct().collect()]  # at most `buckets`
        return stored.where((F.col(BATCH) != batch_id) & F.col(BUCKET).isin(touched)).select(*KEYS, "is_voided")

    def _write(self, rows: DataFrame, batch_id: int, full: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        """A month and bucket is one task unless it is large; Spark then splits it."""
        (
            full(
                rows.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
                .hint("rebalance", MONTH, BUCKET)
                .sortWithinPartitions(*LAYOUT, "org_id", "occurred_at")
            )
            .select(*self.schema.names, *LAYOUT)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*LAYOUT)
            .parquet(self.path)
        )

    def purge_before(self, day: dt.date, as_of: dt.date) -> DataFrame:
        """Drop the months that end before `day`. Returns an audit row per dropped partition; the others keep their files.

        Partitions and their counts come from the layout and the file footers. The list of partitions passes the
        driver: months times buckets times batches, never rows.
        """
        old = self.read().where(F.col(MONTH) < F.lit(day.replace(day=1)))
        audit = written(old.groupBy(*LAYOUT).agg(F.count("*").alias("n")).withColumn("dropped_on", F.lit(as_of)), "purge-audit")
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for r in audit.select(*LAYOUT).collect():
            part = "/".join(f"{name}={value}" for name, value in zip(LAYOUT, r, strict=True))
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}"), True)
        return audit


def fingerprint(spark: SparkSession, paths: list[str]) -> tuple[int, int]:
    """A number that changes when a file of the paths does, and the bytes of all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    told = files.agg(F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return told[0], told[1]


def buckets_for(total_bytes: int) -> int:
    return max(1, min(MOST_BUCKETS, total_bytes // BYTES_PER_BUCKET))
