"""Calendar and shift labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First hour, hour after the last, label (with an en dash).
SHIFTS = (
    (6, 9, "06–08"),
    (9, 12, "09–11"),
    (12, 15, "12–14"),
    (15, 18, "15–17"),
)
NIGHT_SHIFT = "Other (Night/Early Morning)"

SHIFT_LABELS = (*(name for _, _, name in SHIFTS), NIGHT_SHIFT)


def shift(hour: Column) -> Column:
    """Label of the shift ``hour`` falls in. Other hours, and NULL, are the night shift."""
    label = F.lit(NIGHT_SHIFT)
    for first, end, name in SHIFTS:
        label = F.when((hour >= first) & (hour < end), name).otherwise(label)
    return label


def weekday(date: Column) -> Column:
    """Three-letter English weekday."""
    return F.date_format(date, "EEE")


def weekday_order(date: Column) -> Column:
    """Position of the weekday in a week that starts on Sunday (1) and ends on Saturday (7)."""
    return F.dayofweek(date)
