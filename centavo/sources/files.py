"""Delimited imports, tenant exports and retention."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from centavo.functions.money import DECIMAL_TEXT
from centavo.functions.periods import shift_months
from centavo.operators.normalize import stable_id
from centavo.operators.tenancy import scoped

# Years each class of table is kept; personal data goes this many
# days after an account is closed; the audit log is never purged.
RETENTION_YEARS = {"financial": 7, "raw": 7, "trace": 3}
PERSONAL_DATA_DAYS = 30


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A delimited file with a header and quoted cells, all cells as text; `bad_line` holds lines of another shape."""
    schema = ", ".join([*(f"`{c}` string" for c in columns), "bad_line string"])
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", False)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_line").csv(path)


def import_delimited(
    rows: DataFrame,
    mapping: Mapping[str, str],
    date_format: str = "yyyy-MM-dd",
    tenant: str = "org_id",
) -> DataFrame:
    """A user's file to canonical transactions by a column mapping.

    `mapping` names the file's columns for `date`, `amount` and optionally
    `description`, `merchant`, `direction`. A signed amount gives the direction
    when none is mapped. Rows with an unreadable date or amount are left to
    `import_rejects`.
    """
    return _parsed(rows, mapping, date_format, tenant).where(F.col("amount").isNotNull() & F.col("occurred_at").isNotNull())


def import_rejects(
    rows: DataFrame, mapping: Mapping[str, str], date_format: str = "yyyy-MM-dd", tenant: str = "org_id"
) -> DataFrame:
    parsed = _parsed(rows, mapping, date_format, tenant)
    reason = F.when(F.col("occurred_at").isNull(), "unreadable date").otherwise("unreadable amount")
    return parsed.where(F.col("amount").isNull() | F.col("occurred_at").isNull()).select(
        "org_id", "source_txn_id", reason.alias("reason")
    )


def _parsed(rows: DataFrame, mapping: Mapping[str, str], date_format: str, tenant: str) -> DataFrame:
    def mapped(name: str) -> Column:
        return F.col(mapping[name]) if name in mapping else F.lit(None).cast("string")

    cleaned = F.regexp_replace(F.trim(mapped("amount")), r"[$,\s]", "")
    value = F.when(cleaned.rlike(DECIMAL_TEXT), F.round(cleaned.try_cast("decimal(24,6)"), 2))
    direction = (
        F.lower(mapped("direction"))
        if "direction" in mapping
        else F.when(value < 0, "outflow").otherwise("inflow")
    )
    day = F.try_to_date(F.trim(mapped("date")), date_format)
    # equal rows are different payments: each is numbered within its likes
    same = Window.partitionBy("_id").orderBy("_id")
    numbered = rows.withColumn("_id", stable_id(*[tenant, *mapping.values()])).withColumn("_nth", F.row_number().over(same))
    return numbered.select(
        F.col(tenant).alias("org_id"),
        F.when(F.col("_nth") == 1, F.col("_id")).otherwise(F.sha2(F.concat_ws(":", "_id", "_nth"), 256)).alias("source_txn_id"),
        F.lit("Import").alias("source_record_type"),
        direction.alias("direction"),
        F.abs(value).cast("decimal(20,4)").alias("amount"),
        day.alias("occurred_at"),
        day.alias("posted_at"),
        mapped("description").alias("description"),
        mapped("merchant").alias("merchant_name"),
    )


def retained(df: DataFrame, table_class: str, day: str, as_of: dt.date) -> DataFrame:
    """Rows still inside their class's retention; a class without a limit keeps all."""
    years = RETENTION_YEARS.get(table_class)
    return df if years is None else df.where(F.col(day) > F.lit(shift_months(as_of, -12 * years)))


def without_personal_data(df: DataFrame, closed: DataFrame, columns: Sequence[str], as_of: dt.date) -> DataFrame:
    """Null the personal columns of tenants closed longer than the grace period."""
    due = closed.where(F.col("closed_on") <= F.lit(as_of - dt.timedelta(days=PERSONAL_DATA_DAYS))).select(
        "org_id", F.lit(True).alias("_purge")
    )
    joined = df.join(due.dropDuplicates(["org_id"]), "org_id", "left")
    keep = F.col("_purge").isNull()
    return joined.withColumns({c: F.when(keep, F.col(c)) for c in columns}).drop("_purge").select(df.columns)


def export_tenant(tables: Mapping[str, DataFrame], org_id: str | int, path: str, file_format: str = "parquet") -> None:
    """Write every table of one tenant below `path`, one folder per table."""
    for name, df in tables.items():
        scoped(df, org_id).write.mode("overwrite").format(file_format).option("header", "true").save(f"{path}/{name}")
