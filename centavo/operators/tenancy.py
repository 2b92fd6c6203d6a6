"""Tenant scope. A frame scoped to no tenant holds no rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the text form of a tenant id.
UUID_TEXT = re.compile(
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", re.IGNORECASE
)


class TenantError(ValueError):
    """A tenant id that cannot be used as a scope."""


def _match(df: DataFrame, org_id: str | int | None, key: str) -> Column:
    if org_id is None or org_id == "":
        return F.lit(False)
    kind = df.schema[key].dataType
    if isinstance(kind, T.IntegralType):
        if isinstance(org_id, bool) or not isinstance(org_id, int):
            raise TenantError(f"tenant id is not an integer: {org_id!r}")
        return F.col(key) == F.lit(org_id)
    if not isinstance(org_id, str) or not UUID_TEXT.match(org_id):
        raise TenantError(f"tenant id is not a UUID: {org_id!r}")
    return F.col(key) == F.lit(org_id.lower())


def scoped(df: DataFrame, org_id: str | int | None, key: str = "org_id") -> DataFrame:
    """Rows of one tenant; none when unset; an error on a malformed id."""
    return df.where(_match(df, org_id, key))


def scoped_with_shared(df: DataFrame, org_id: str | int | None, key: str = "org_id") -> DataFrame:
    """Rows of one tenant plus system rows, which carry no tenant."""
    return df.where(F.col(key).isNull() | _match(df, org_id, key))


def checked_writes(df: DataFrame, org_id: str | int | None, key: str = "org_id") -> DataFrame:
    """Rows about to be written; a row of another tenant fails the job."""
    owned = F.coalesce(_match(df, org_id, key), F.lit(False))
    return df.withColumn(
        key,
        F.when(owned, F.col(key)).otherwise(
            F.raise_error(F.lit("row belongs to another tenant")).cast(df.schema[key].dataType)
        ),
    )


def reachable(df: DataFrame, grants: DataFrame, key: str) -> DataFrame:
    """Rows of an unscoped table that a scoped membership table reaches."""
    return df.join(grants.select(key), key, "left_semi")
