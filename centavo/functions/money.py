"""Money as column expressions.

Amounts are stored as DECIMAL(20,4) holding whole cents and are computed as
BIGINT minor units: integer sums stay inside code generation, are exact in any
order of evaluation, and fail loudly on overflow under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: minor units in a major one, for currencies of two decimal places.
MINOR_PER_MAJOR = 100

DECIMAL_TEXT = r"^-?\d+(\.\d+)?$"
EXCESS_PRECISION = r"\.\d\d\d*[1-9]"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def minor(amount: Column | str) -> Column:
    """Whole minor units of a decimal amount, half away from zero."""
    return F.round(_col(amount) * F.lit(MINOR_PER_MAJOR)).cast("bigint")


def major(minor_units: Column | str) -> Column:
    """DECIMAL(20,4) amount of a BIGINT count of minor units."""
    cent = F.lit("0.01").cast("decimal(3,2)")
    return (_col(minor_units).cast("decimal(18,0)") * cent).cast("decimal(20,4)")


def signed(direction: Column | str, value: Column) -> Column:
    """Inflow counts up, outflow counts down."""
    return F.when(_col(direction) == "inflow", value).otherwise(-value)


def floor_div(num: Column, den: Column | int) -> Column:
    """Floor division by a positive divisor, exact on BIGINT."""
    den = den if isinstance(den, Column) else F.lit(den).cast("bigint")
    return F.call_function("div", num - F.pmod(num, den), den)


def half_up_mean(total: Column, n: Column | int) -> Column:
    """total / n to the nearest integer, halves toward plus infinity; null when n is 0."""
    n = n if isinstance(n, Column) else F.lit(n).cast("bigint")
    return F.when(n > 0, floor_div(total * 2 + n, n * 2))


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Round a double at `digits` decimals, halves toward plus infinity."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def percent(part: Column, whole: Column) -> Column:
    """part / whole in percent at two decimals."""
    ratio = part.cast("double") / whole.cast("double")
    return F.floor(ratio * F.lit(10000.0) + F.lit(0.5)).cast("double") / F.lit(100.0)


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 when the whole is not positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def scale_minor(minor_units: Column | str, factor: str) -> Column:
    """Multiply by an exact decimal factor, half away from zero."""
    product = _col(minor_units).cast("decimal(18,0)") * F.lit(factor).cast("decimal(10,6)")
    return F.round(product).cast("bigint")


def allocate(minor_units: Column | str, parts: Column | int) -> Column:
    """Array of `parts` shares that add up to the input, extra cents first."""
    value = _col(minor_units)
    n = parts if isinstance(parts, Column) else F.lit(parts)
    n = n.cast("bigint")
    size = F.abs(value)
    base = floor_div(size, n)
    extra = size - base * n
    sign = F.when(value < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), n - 1),
        lambda i: sign * (base + F.when(i < extra, F.lit(1)).otherwise(F.lit(0)).cast("bigint")),
    )


def parse_minor(text: Column | str) -> Column:
    """Minor units of plain decimal text; null for other text or for sub-cent digits."""
    trimmed = F.trim(_col(text))
    ok = trimmed.rlike(DECIMAL_TEXT) & ~trimmed.rlike(EXCESS_PRECISION)
    return F.when(ok, minor(trimmed.try_cast("decimal(24,6)")))


def round_minor(text: Column | str) -> Column:
    """Minor units of any finite decimal text, rounded half away from zero."""
    trimmed = F.trim(_col(text))
    return F.when(trimmed.rlike(DECIMAL_TEXT), minor(trimmed.try_cast("decimal(30,10)")))


def compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def format_usd(minor_units: Column | str) -> Column:
    """`$1,234.50` or `-$1,234.50`; presentation only."""
    value = _col(minor_units)
    size = F.abs(value)
    whole = F.format_number(floor_div(size, 100), 0)
    cents = F.lpad(F.pmod(size, F.lit(100)).cast("string"), 2, "0")
    return F.concat(F.when(value < 0, "-$").otherwise("$"), whole, F.lit("."), cents)


def sum_one_currency(amount_minor: Column | str, currency: Column | str) -> Column:
    """Sum that refuses a group holding more than one currency."""
    lo, hi = F.min(_col(currency)), F.max(_col(currency))
    total = F.sum(_col(amount_minor))
    return F.when(lo.eqNullSafe(hi), total).otherwise(
        F.raise_error(F.lit("currency mismatch in one sum")).cast("bigint")
    )
