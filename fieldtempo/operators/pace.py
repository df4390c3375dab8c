"""Daily pace: deliveries per enumerator and day, averaged by day, without outlier days.

All deliveries and the accurate ones are counted in the same aggregate, so one scan and one shuffle
serve both datasets and no row is duplicated. Map-side combine leaves at most one row per task for
an enumerator's day, however many deliveries that day holds; NULL dates and enumerators are groups
like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtempo.functions import SHIFT_LABELS

CAMPAIGN = ("city", "year")
CAMPAIGN_DATASET = (*CAMPAIGN, "dataset")

# The dataset labels and the reach of the outlier fences.
UNFILTERED = "Unfiltered"
FILTERED = "Filtered"
FENCE_REACH = 1.5


def _by_dataset(wide: DataFrame, ids: Sequence[str], value: str) -> DataFrame:
    """One row per dataset; a dataset without a value has no row."""
    return wide.unpivot(list(ids), [UNFILTERED, FILTERED], "dataset", value).where(
        F.col(value).isNotNull()
    )


def count_enumerator_days(
    deliveries: DataFrame, keys: Sequence[str] = CAMPAIGN, by_shift: bool = False
) -> DataFrame:
    """``deliveries`` and ``accurate`` per key, day and enumerator.

    ``by_shift`` needs a ``tod`` column and adds an array of the deliveries in each shift, in the
    order of ``SHIFT_LABELS``: the shifts of a day then share its row in the shuffle, and every
    other table can be computed from the result without another shuffle of this size.
    """
    counts = [
        F.count(F.lit(1)).alias("deliveries"),
        F.count_if(F.col("distance") <= F.col("threshold")).alias("accurate"),
    ]
    if by_shift:
        in_shift = [F.count_if(F.col("tod") == label) for label in SHIFT_LABELS]
        counts.append(F.array(*in_shift).alias("by_shift"))
    return deliveries.groupBy(*keys, "date", "enumerator").agg(*counts)


def enumerator_daily_counts(deliveries: DataFrame, keys: Sequence[str] = CAMPAIGN) -> DataFrame:
    """``enum_daily_deliv`` per dataset, day and enumerator; no row where there is no delivery."""
    days = count_enumerator_days(deliveries, keys).select(
        *keys,
        "date",
        "enumerator",
        F.col("deliveries").alias(UNFILTERED),
        F.nullif("accurate", F.lit(0)).alias(FILTERED),
    )
    return _by_dataset(days, [*keys, "date", "enumerator"], "enum_daily_deliv")


def average_days(days: DataFrame, keys: Sequence[str] = CAMPAIGN) -> DataFrame:
    """``daily_avg`` per dataset and day, over the enumerators active that day."""
    averaged = days.groupBy(*keys, "date").agg(
        F.avg("deliveries").alias(UNFILTERED),
        F.avg(F.nullif("accurate", F.lit(0))).alias(FILTERED),
    )
    return _by_dataset(averaged, [*keys, "date"], "daily_avg")


def daily_pace(deliveries: DataFrame, keys: Sequence[str] = CAMPAIGN) -> DataFrame:
    """``daily_avg`` per dataset and day, straight from deliveries."""
    return average_days(count_enumerator_days(deliveries, keys), keys)


def iqr_trim(
    daily: DataFrame,
    value: str = "daily_avg",
    keys: Sequence[str] = CAMPAIGN_DATASET,
    reach: float = FENCE_REACH,
) -> DataFrame:
    """Drop, in one pass, days outside the quartile fences of their key; fences are inclusive.

    ``daily`` has one row per key and day, so a window partition is bounded by the calendar.
    """
    quartiles = F.percentile(value, [0.25, 0.75]).over(Window.partitionBy(*keys))
    fenced = daily.withColumn("_quartiles", quartiles).withColumns(
        {
            "Q1": F.col("_quartiles")[0],
            "Q3": F.col("_quartiles")[1],
            "IQR": F.col("_quartiles")[1] - F.col("_quartiles")[0],
        }
    )
    return fenced.drop("_quartiles").where(
        F.col(value).between(
            F.col("Q1") - reach * F.col("IQR"), F.col("Q3") + reach * F.col("IQR")
        )
    )


def all_daily_pace(deliveries: DataFrame, keys: Sequence[str] = CAMPAIGN) -> DataFrame:
    """Trimmed daily pace of every campaign and dataset."""
    return iqr_trim(daily_pace(deliveries, keys), keys=[*keys, "dataset"])
