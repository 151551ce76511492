"""Column expressions for flow measures. Everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO_FLOOR = 1e-9


def round_scaled(value: Column, digits: int) -> Column:
    """Rounding by scaling in doubles, as the SQL of the queries does it: 0.020085 to five digits is 0.02008, as the
    double nearest to it times 1e5 lies below 2008.5; Spark's own rounding takes the decimal and gives 0.02009."""
    scale = F.lit(10.0 ** digits)
    return F.round(value * scale, 0) / scale


def nonnegative(df: DataFrame, name: str) -> Column:
    """Double value of a column: unreadable, missing and negative values become 0."""
    if name not in df.columns:
        return F.lit(0.0)
    number = F.col(f"`{name}`").try_cast("double")
    return F.greatest(F.nanvl(F.coalesce(number, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def rate(amount: Column, base: Column) -> Column:
    """amount / base, 0 where the base is not positive."""
    return F.when(base > 0, amount / base).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole kept within [0, 1]."""
    return F.least(F.greatest(part / (whole + F.lit(RATIO_FLOOR)), F.lit(0.0)), F.lit(1.0))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch (sessions run in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value.cast("bigint")).cast("timestamp_ntz")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the denominator is 0."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def moment(text: str) -> Column:
    """A timestamp literal that folds to a constant, so range filters reach the scan."""
    return F.lit(text).cast("timestamp_ntz")


def significant(value: Column, decimals: int = 3) -> Column:
    """Round to ``decimals`` digits after the leading one."""
    return F.when(value.isNotNull(), F.format_string(f"%.{decimals}e", value).try_cast("double"))
