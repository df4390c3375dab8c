"""Pace by shift and weekday: all deliveries, no accuracy filter, no trimming.

The ``*_profile`` functions start from ``profile_base``, the ``pace_by_*`` functions from deliveries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtempo.functions import SHIFT_LABELS, weekday, weekday_order
from fieldtempo.operators.pace import CAMPAIGN, count_enumerator_days


def profile_base(days: DataFrame, keys: Sequence[str] = CAMPAIGN) -> DataFrame:
    """Sum and number of the counts by weekday and shift, in one pass over day counts.

    A row without ``tod`` has the counts of whole days; counts without ``by_shift`` give only those.
    There are at most 7 weekdays and a missing one, each with the shifts and one such row, for every
    key; all profiles follow from it.
    """
    counts, labels = F.array("deliveries"), F.array().cast("array<string>")
    if "by_shift" in days.columns:
        counts = F.array_append("by_shift", F.col("deliveries"))
        labels = F.array(*[F.lit(label) for label in SHIFT_LABELS])
    active = days.select(*keys, "date", F.posexplode(counts).alias("number", "deliveries"))
    # The weekday follows from the date, so it is added to the counts, not grouped on below them.
    return (
        active.where(F.col("deliveries") > 0)
        .select(
            *keys,
            weekday(F.col("date")).alias("dow"),
            weekday_order(F.col("date")).alias("dow_order"),
            F.get(labels, F.col("number")).alias("tod"),
            "deliveries",
        )
        .groupBy(*keys, "dow", "dow_order", "tod")
        .agg(F.sum("deliveries").alias("total"), F.count("deliveries").alias("days"))
    )


def _averages(base: DataFrame, by: Sequence[str], whole_days: bool, name: str) -> DataFrame:
    rows = base.where(F.col("tod").isNull() if whole_days else F.col("tod").isNotNull())
    return rows.groupBy(*by).agg((F.sum("total") / F.sum("days")).alias(name))


def tod_profile(base: DataFrame, keys: Sequence[str] = CAMPAIGN) -> DataFrame:
    """Average deliveries of an enumerator in a shift."""
    return _averages(base, [*keys, "tod"], False, "avg_daily_pace_tod")


def dow_profile(base: DataFrame, keys: Sequence[str] = CAMPAIGN) -> DataFrame:
    """Average deliveries of an enumerator on a weekday."""
    return _averages(base, [*keys, "dow", "dow_order"], True, "avg_daily_pace_dow")


def dow_tod_profile(base: DataFrame, keys: Sequence[str] = CAMPAIGN) -> DataFrame:
    """Average deliveries of an enumerator in a shift of a weekday."""
    return _averages(base, [*keys, "dow", "tod", "dow_order"], False, "avg_daily_pace_tod_dow")


def _base(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    return profile_base(count_enumerator_days(features, keys, by_shift=True), keys)


def pace_by_tod(features: DataFrame, keys: Sequence[str] = CAMPAIGN) -> DataFrame:
    return tod_profile(_base(features, keys), keys)


def pace_by_dow(features: DataFrame, keys: Sequence[str] = CAMPAIGN) -> DataFrame:
    return dow_profile(_base(features, keys), keys)


def pace_by_dow_tod(features: DataFrame, keys: Sequence[str] = CAMPAIGN) -> DataFrame:
    return dow_tod_profile(_base(features, keys), keys)
