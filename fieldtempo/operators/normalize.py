"""Row-level cleaning of canonical deliveries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtempo.functions import parse_dmy_hms, shift, weekday, weekday_order

# Fixed value: what separates the entries of a multi-value column.
LIST_SEPARATOR = r",\s*"


def drop_missing_dates(deliveries: DataFrame, raw: str = "delivered_raw") -> DataFrame:
    """Drop rows without a date text. Rows whose text cannot be read stay, with a NULL date."""
    return deliveries.where(F.col(raw).isNotNull())


def split_multivalue(
    deliveries: DataFrame, column: str = "property_type", separator: str = LIST_SEPARATOR
) -> DataFrame:
    """One row per listed value, each a delivery of its own. A NULL list stays one row."""
    return deliveries.withColumn(column, F.explode_outer(F.split(column, separator)))


def accuracy_filter(deliveries: DataFrame) -> DataFrame:
    """Keep deliveries within the threshold, its edge included; unknown distances go."""
    return deliveries.where(F.col("distance") <= F.col("threshold"))


def bad_dates(
    deliveries: DataFrame,
    raw: str = "delivered_raw",
    parse: Callable[[DataFrame, str, str], DataFrame] = parse_dmy_hms,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The distinct texts, per key if any, that are present but cannot be read.

    Best run on rows as read, before a split repeats their texts.
    """
    texts = deliveries.select(*keys, raw).where(F.col(raw).isNotNull())
    parsed = parse(texts, raw, "_parsed")
    return parsed.where(F.col("_parsed").isNull()).select(*keys, raw).distinct()


def time_features(deliveries: DataFrame, timestamp: str = "delivered_ts") -> DataFrame:
    """Add date, weekday (label and Sunday-first position), hour and shift."""
    date = F.to_date(timestamp)
    hour = F.hour(timestamp)
    return deliveries.withColumns(
        {
            "date": date,
            "dow": weekday(date),
            "dow_order": weekday_order(date),
            "hour": hour,
            "tod": shift(hour),
        }
    )
