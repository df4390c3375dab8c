"""Column functions: header names, timestamps, shifts."""

from fieldtempo.functions.headers import snake_case_names
from fieldtempo.functions.shifts import (
    NIGHT_SHIFT,
    SHIFT_LABELS,
    SHIFTS,
    shift,
    weekday,
    weekday_order,
)
from fieldtempo.functions.timestamps import (
    MIXED_ORDERS,
    parse_delivered,
    parse_dmy_hms,
    parse_iso,
    parse_mdy_hm,
    parse_mixed,
)

__all__ = [
    "MIXED_ORDERS",
    "NIGHT_SHIFT",
    "SHIFTS",
    "SHIFT_LABELS",
    "parse_delivered",
    "parse_dmy_hms",
    "parse_iso",
    "parse_mdy_hm",
    "parse_mixed",
    "shift",
    "snake_case_names",
    "weekday",
    "weekday_order",
]
