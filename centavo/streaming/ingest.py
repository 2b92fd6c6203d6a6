"""Landing folder to page index and record log, resumable and safe to replay.

Each micro-batch writes only its own partition of the target, so a batch that
runs again after a crash replaces its own output. A page seen in an earlier
batch, however long ago, is dropped by an anti join against the page index. No
watermark stands ahead of it: a page landed late, older than everything
archived, is archived like any other. The index is partitioned by a prefix of the
content hash, so a batch looks up only the parts its own hashes name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from centavo.operators.normalize import latest_records
from centavo.sources import landing

PAGE_KEY = ["connection_id", "record_type", "content_hash"]

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("org_id", T.IntegerType()),
        T.StructField("connection_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("page_index", T.IntegerType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("payload", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("record_count", T.IntegerType()),
        T.StructField("byte_size", T.IntegerType()),
        T.StructField("object_key", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("bucket", T.StringType()),
    ]
)


def landing_stream(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame:
    """Landed pages as a stream, with content hash and record count."""
    schema = T.StructType([*landing.PAGE_SCHEMA.fields, T.StructField("fetch_date", T.DateType())])
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)
    return landing.with_page_facts(pages.drop("fetch_date"))


def read_index(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame:
    """Pages archived so far; optionally only those of earlier batches."""
    index = spark.read.schema(INDEX_SCHEMA).parquet(path)
    return index if before_batch is None else index.where(F.col("batch_id") < before_batch)


def write_new_pages(target: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that appends the pages not archived by an earlier batch.

    The batch is staged first, so the stateful stream plan runs once however
    often its rows are read. Only the keys of this batch are looked up in the
    index, which is scanned but not shuffled while the batch's keys are few.
    """
    stored = T.StructType([f for f in INDEX_SCHEMA.fields if f.name != "batch_id"])
    columns = [f.name for f in stored if f.name != "bucket"]
    bucket = F.substring("content_hash", 1, 2).alias("bucket")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged_path = f"{target}-staged/batch_id={batch_id}"
        landing.unique_pages(batch).select(*columns, bucket).write.mode("overwrite").parquet(staged_path)
        staged = spark.read.schema(stored).parquet(staged_path)
        fresh = staged
        if _exists(spark, target):
            named = [r.bucket for r in staged.select("bucket").distinct().collect()]  # at most 256
            archived = read_index(spark, target, batch_id).where(F.col("bucket").isin(named)).select(*PAGE_KEY)
            seen = archived.join(staged.select(*PAGE_KEY), PAGE_KEY, "left_semi")
            fresh = staged.join(seen, PAGE_KEY, "left_anti")
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch_id={batch_id}")

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        read_index(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def backfill(spark: SparkSession, landing_path: str, target: str, checkpoint: str) -> StreamingQuery:
    """Archive everything landed and not yet processed, then stop; progress is the checkpoint."""
    return (
        landing_stream(spark, landing_path)
        .writeStream.foreachBatch(write_new_pages(target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_records(spark: SparkSession, target: str) -> DataFrame:
    """Latest version of every archived record: edits replace, replays change nothing."""
    return latest_records(landing.records(read_index(spark, target)))
