"""Invoice document state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_status(total: Column, balance: Column, due_date: Column, as_of: dt.date) -> Column:
    """paid, else overdue, else partial, else open, as of an explicit date."""
    return (
        F.when(balance == 0, "paid")
        .when(due_date < F.lit(as_of), "overdue")
        .when(balance < total, "partial")
        .otherwise("open")
    )
