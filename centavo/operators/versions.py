"""Keep-one and merge operators for at-least-once input."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in `order`.

    The rank limit is applied before the shuffle as well, so a key with many
    copies sends one row per input task, not all of them.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First `n` rows per key with their `rank`; also limited before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def merge_update(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
    order: Sequence[Column],
) -> DataFrame:
    """Insert new keys; for known keys replace only the `update` columns.

    `incoming` may hold several versions of a key; the first in `order` wins.
    Both sides are reduced to one row per key before the join.
    """
    new = latest_by(incoming, keys, order)
    columns = existing.columns
    joined = existing.alias("o").join(
        new.select(*columns).withColumn("_new", F.lit(True)).alias("n"),
        on=[F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys],
        how="full_outer",
    )
    old_row = F.col(f"o.{keys[0]}").isNotNull()
    out = []
    for name in columns:
        old, fresh = F.col(f"o.{name}"), F.col(f"n.{name}")
        if name in keys:
            out.append(F.coalesce(old, fresh).alias(name))
        elif name in update:
            out.append(F.when(F.col("n._new"), fresh).otherwise(old).alias(name))
        else:
            out.append(F.when(old_row, old).otherwise(fresh).alias(name))
    return joined.select(*out)


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The incoming rows to append: one per key, none already present and live."""
    present = existing.where(~F.col("is_voided")) if "is_voided" in existing.columns else existing
    return latest_by(incoming, keys, order).join(present.select(*keys), list(keys), "left_anti")


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on null-safe equality of `keys`; `right` holds one row per key."""
    others = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *others)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], row_id: str, spread: int = 64) -> DataFrame:
    """Left join to a table of one row per key, with the keyless rows spread out.

    Rows whose key is null match nothing but would all hash to one partition;
    they get a salt of their own, rows with a key get salt 0 like the right side.
    """
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salt = F.when(missing, F.pmod(F.xxhash64(row_id), F.lit(spread)).cast("int")).otherwise(0)
    return (
        left.withColumn("_salt", salt)
        .join(right.withColumn("_salt", F.lit(0)), [*keys, "_salt"], "left")
        .drop("_salt")
    )
