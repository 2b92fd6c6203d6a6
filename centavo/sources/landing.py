"""Raw provider pages: landing, scan, content hash, listing and record extraction.

A page is one provider response kept verbatim as JSON text:
`{"QueryResponse": {"<Type>": [record, ...], ...}, "time": ...}`. The array is
left out of an empty page, and `time` differs on every fetch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centavo.operators.versions import latest_by, top_per

# Fixed value: how many records fill a page.
PAGE_SIZE = 500

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("org_id", T.IntegerType()),
        T.StructField("connection_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("page_index", T.IntegerType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("payload", T.StringType()),
    ]
)
PARTITIONS = ("org_id", "connection_id", "record_type", "fetch_date")
SPREAD = 8


def page_records(payload: Column, record_type: Column) -> Column:
    """The record array of a page as ARRAY<VARIANT>; empty when the page has none."""
    body = F.from_json(payload, "QueryResponse map<string,variant>")["QueryResponse"]
    return F.coalesce(body[record_type].try_cast("array<variant>"), F.array().cast("array<variant>"))


def content_hash(payload: Column, record_type: Column) -> Column:
    """SHA-256 of the records only, keys sorted at every depth."""
    body = F.from_json(payload, "QueryResponse map<string,variant>")["QueryResponse"]
    return F.sha2(F.coalesce(F.to_json(body[record_type]), F.lit("[]")), 256)


def with_page_facts(pages: DataFrame) -> DataFrame:
    """Add content hash, record count and object key to each page."""
    return _parsed_pages(pages).drop("_records")


def _parsed_pages(pages: DataFrame) -> DataFrame:
    """Pages with their facts and, as VARIANT, their parsed records."""
    records = F.from_json("payload", "QueryResponse map<string,variant>")["QueryResponse"][F.col("record_type")]
    text = F.coalesce(F.to_json("_records"), F.lit("[]"))
    return (
        pages.withColumn("_records", records)
        .withColumn("content_hash", F.sha2(text, 256))
        .withColumn("record_count", F.coalesce(F.json_array_length(text), F.lit(0)))
        .withColumn("byte_size", F.octet_length("payload"))
        .withColumn(
            "object_key",
            F.concat_ws(
                "/",
                F.col("org_id").cast("string"),
                "connection_id",
                "record_type",
                F.date_format("fetched_at", "yyyy/MM/dd"),
                F.concat(F.substring("content_hash", 1, 32), F.lit(".json.gz")),
            ),
        )
    )


def unique_pages(pages: DataFrame) -> DataFrame:
    """First fetch of each distinct page; a page fetched again after a crash is dropped."""
    hashed = pages if "content_hash" in pages.columns else with_page_facts(pages)
    return _first_fetches(hashed)


def _first_fetches(hashed: DataFrame) -> DataFrame:
    """Pages are dealt by key first, so that they are sorted once, not in every input task as well."""
    keys = ["connection_id", "record_type", "content_hash"]
    return latest_by(hashed.repartition(*keys), keys, [F.col("fetched_at"), F.col("page_index")])


def unique_records(pages: DataFrame) -> DataFrame:
    """The `records` of the `unique_pages` of fetched pages, each page parsed once."""
    parsed = _first_fetches(_parsed_pages(pages))
    held = F.coalesce(F.col("_records").try_cast("array<variant>"), F.array().cast("array<variant>"))
    return _exploded(parsed, held)


def records(pages: DataFrame) -> DataFrame:
    """One row per record of the pages, with the record as VARIANT and its place in the page."""
    return _exploded(pages, page_records(F.col("payload"), F.col("record_type")))


def _exploded(pages: DataFrame, held: Column) -> DataFrame:
    return pages.select(
        "org_id",
        "connection_id",
        "record_type",
        "fetched_at",
        "page_index",
        F.posexplode(held).alias("position", "record"),
    )


def write_pages(pages: DataFrame, path: str) -> None:
    """Append pages to the landing folder, tenant first so one tenant can be dropped by prefix."""
    dated = pages.withColumn("fetch_date", F.to_date("fetched_at"))
    spread = F.pmod(F.xxhash64("page_index", "payload"), F.lit(SPREAD))
    (
        dated.repartition(*PARTITIONS, spread)  # few files per partition, yet no partition in one task
        .write.mode("append")
        .partitionBy(*PARTITIONS)
        .option("compression", "gzip")
        .json(path)
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages; partition columns prune by tenant, connection, type and date."""
    schema = T.StructType([*PAGE_SCHEMA.fields, T.StructField("fetch_date", T.DateType())])
    return spark.read.schema(schema).json(path)


def list_pages(pages: DataFrame, n: int = 50) -> DataFrame:
    """The newest n pages of each connection and record type."""
    order = [F.col("fetched_at").desc(), F.col("page_index"), F.col("content_hash")]
    slim = pages.select(
        "org_id", "connection_id", "record_type", "object_key", "record_count", "page_index", "fetched_at", "content_hash"
    )
    return top_per(slim, ["connection_id", "record_type"], order, n)


def updated_since(rows: DataFrame, since: Column) -> DataFrame:
    """Records edited at or after `since`; the creation time would miss edits."""
    updated = F.try_variant_get("record", "$.MetaData.LastUpdatedTime", "timestamp")
    return rows.withColumn("updated_at", updated).where(F.col("updated_at") >= since)
