"""Scalar column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.schemas import PANDAS_NA_TOKENS

ColumnOrName = Column | str

_US_PER_DAY = 86_400_000_000.0


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_timestamp(x: ColumnOrName) -> Column:
    """Text to ``timestamp_ntz``; unparseable text becomes null instead of failing.

    A column that is already ``timestamp_ntz`` passes through unchanged.
    """
    return _c(x).try_cast(T.TimestampNTZType())


def na_to_null(x: ColumnOrName) -> Column:
    """Map the CSV cells pandas reads as missing (``NA``, ``null``, empty, ...) to null."""
    c = _c(x)
    return F.when(c.isin(PANDAS_NA_TOKENS), F.lit(None).cast(T.StringType())).otherwise(c)


def nan_to_null(x: ColumnOrName) -> Column:
    """Floating NaN to null, so ``avg``/``sum`` skip it like pandas does."""
    c = _c(x)
    return F.nanvl(c, F.lit(None).cast(T.DoubleType()))


def fractional_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``(end - start)`` in days as a double, keeping sub-second precision."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(_US_PER_DAY)


def late_flag(delivered: ColumnOrName, estimated: ColumnOrName) -> Column:
    """1 when delivery is strictly after the estimate (full timestamps, not dates)."""
    return (_c(delivered) > _c(estimated)).cast(T.IntegerType())


def delivery_status(is_late: ColumnOrName) -> Column:
    c = _c(is_late)
    return F.when(c == 1, F.lit("Late")).when(c == 0, F.lit("On Time"))


def purchase_period(ts: ColumnOrName) -> Column:
    """Calendar month as ``yyyy-MM`` text."""
    return F.date_format(_c(ts), "yyyy-MM")


def fill_unknown(x: ColumnOrName) -> Column:
    return F.coalesce(_c(x).cast(T.StringType()), F.lit("Unknown"))


def as_double(x: ColumnOrName) -> Column:
    return _c(x).cast(T.DoubleType())


def safe_ratio(num: ColumnOrName, den: ColumnOrName, default: float | None = 0.0) -> Column:
    """``num / den`` when ``den > 0``, else ``default``; null when ``den`` is null.

    ANSI-safe: never divides by zero. A null denominator only arises from an
    empty view (sum over no rows), which has no ratio at all.
    """
    n, d = as_double(num), as_double(den)
    fallback = F.lit(default).cast(T.DoubleType())
    return F.when(d > 0, n / d).when(d.isNotNull(), fallback)


def share_of_collected(freight: ColumnOrName, revenue: ColumnOrName) -> Column:
    """Freight share of (revenue + freight); 0.0 when that sum is not positive."""
    total = as_double(revenue) + as_double(freight)
    return F.when(total > 0, as_double(freight) / total).when(total.isNotNull(), F.lit(0.0))


def share_or_null(freight: ColumnOrName, revenue: ColumnOrName) -> Column:
    """Freight share per group; null when revenue + freight is exactly 0."""
    total = as_double(revenue) + as_double(freight)
    return as_double(freight) / F.nullif(total, F.lit(0.0))


def minimum_group_orders(total_orders: ColumnOrName) -> Column:
    """max(1, min(50, round(orders * 0.05))) with half-to-even rounding."""
    scaled = F.bround(_c(total_orders).cast(T.DoubleType()) * F.lit(0.05), 0)
    return F.greatest(F.lit(1), F.least(F.lit(50), scaled.cast(T.IntegerType())))


def metric(x: ColumnOrName, digits: int = 9) -> Column:
    """Report-level rounding of a floating metric (sums of doubles depend on order)."""
    return F.round(as_double(x), digits)
