"""Column expressions and distributed aggregate helpers."""

from orderlens.functions.aggregates import exact_median, exact_medians, mode_or_unknown, values_at_ranks
from orderlens.functions.columns import (
    delivery_status,
    fill_unknown,
    fractional_days,
    late_flag,
    metric,
    minimum_group_orders,
    na_to_null,
    nan_to_null,
    parse_timestamp,
    purchase_period,
    safe_ratio,
    share_of_collected,
    share_or_null,
)

__all__ = [
    "delivery_status",
    "exact_median",
    "exact_medians",
    "fill_unknown",
    "fractional_days",
    "late_flag",
    "metric",
    "minimum_group_orders",
    "mode_or_unknown",
    "na_to_null",
    "nan_to_null",
    "parse_timestamp",
    "purchase_period",
    "safe_ratio",
    "share_of_collected",
    "share_or_null",
    "values_at_ranks",
]
