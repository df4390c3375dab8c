"""Benchmarks over trimmed days. Every day weighs the same, whatever its enumerators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtempo.operators.pace import CAMPAIGN, CAMPAIGN_DATASET, FILTERED, UNFILTERED


def pace_stats(
    trimmed: DataFrame, keys: Sequence[str] = CAMPAIGN_DATASET, value: str = "daily_avg"
) -> DataFrame:
    """Mean, median, sample deviation, interquartile range, 80th and 90th percentile.

    Percentiles are exact and interpolated; all five share one aggregation state.
    """
    points = F.col("points")
    return (
        trimmed.groupBy(*keys)
        .agg(
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("sd"),
            F.percentile(value, [0.25, 0.5, 0.75, 0.8, 0.9]).alias("points"),
        )
        .select(
            *keys,
            "mean",
            points[1].alias("median"),
            "sd",
            (points[2] - points[0]).alias("iqr"),
            points[3].alias("p80"),
            points[4].alias("p90"),
        )
    )


def summary_all(
    trimmed: DataFrame, keys: Sequence[str] = CAMPAIGN_DATASET, value: str = "daily_avg"
) -> DataFrame:
    """Mean, median, 80th and 90th percentile of every campaign and dataset, in key order."""
    points = F.col("points")
    return (
        trimmed.groupBy(*keys)
        .agg(
            F.avg(value).alias("mean_daily"),
            F.percentile(value, [0.5, 0.8, 0.9]).alias("points"),
        )
        .select(
            *keys,
            "mean_daily",
            points[0].alias("median_daily"),
            points[1].alias("p80"),
            points[2].alias("p90"),
        )
        .orderBy(*[F.asc_nulls_last(key) for key in keys])
    )


def accuracy_comparison(
    trimmed: DataFrame, keys: Sequence[str] = CAMPAIGN, value: str = "daily_avg"
) -> DataFrame:
    """Mean pace of both datasets and how far, in percent, the filter lowers it."""

    def mean_of(dataset: str):
        return F.avg(F.when(F.col("dataset") == dataset, F.col(value)))

    unfiltered, filtered = F.col("unfiltered_mean"), F.col("filtered_mean")
    return (
        trimmed.groupBy(*keys)
        .agg(
            mean_of(UNFILTERED).alias("unfiltered_mean"),
            mean_of(FILTERED).alias("filtered_mean"),
        )
        .withColumn("diff_percent", F.try_divide(unfiltered - filtered, unfiltered) * 100)
    )
