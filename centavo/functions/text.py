"""Name keys used for matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(name: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


# Payment-processor prefixes, store numbers and trailing reference digits seen in
# card descriptors; applied in this order.
MERCHANT_RULES = (
    (r"^(sq|tst|pp|paypal|stripe|pos|ach|chk)\s*[*#-]+\s*", ""),
    (r"\s*#\s*\d+.*$", ""),
    (r"[*#]+", " "),
    (r"\s+\d{3,}$", ""),
    (r"\s+", " "),
)


def merchant_key(descriptor: Column) -> Column:
    """Merchant name in lower case without processor prefix, store or reference number."""
    out = F.lower(F.trim(descriptor))
    for pattern, replacement in MERCHANT_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)
