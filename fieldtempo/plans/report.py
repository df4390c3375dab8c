"""Every result table from one pass over the deliveries.

The deliveries are scanned and shuffled once, into counts per enumerator and day. The counts are
written before use and read twice: for the daily pace and for the base of the profiles. Everything
else is computed from those two with shuffles of a few rows per day, so a lost executor costs a read
of a small table, never a new pass over the deliveries.

A run on a folder that already holds tables goes on where the last one ended: finished tables are
read, others are written again. A lost driver costs what was being written. What the deliveries are
read from is kept with the tables, by name, length and time of change, and input that has changed since
is refused; ``update_report`` is for input that grows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldtempo.operators import chartdata, pace, profile, stats
from fieldtempo.operators.normalize import time_features
from fieldtempo.sources.landing import CAMPAIGN_FOLDERS, land_by_campaign
from fieldtempo.sources.listing import file_states

INPUT = "input"
ENUMERATOR_DAYS = "enumerator_days"
DAILY_PACE = "all_daily_pace"
PROFILE_BASE = "profile_base"


def report_tables(
    base: DataFrame, trimmed: DataFrame, shifts: bool = True, tasks: int | None = None
) -> dict[str, DataFrame]:
    """The tables that follow from the base of the profiles and the trimmed daily pace; those of
    shifts need the time of day. ``tasks`` are those of the curves."""
    tables = {
        "pace_stats": stats.pace_stats(trimmed),
        "summary_all": stats.summary_all(trimmed),
        "accuracy_comparison": stats.accuracy_comparison(trimmed),
        "pace_by_dow": profile.dow_profile(base),
        "pace_timeseries": chartdata.timeseries(trimmed),
        "pace_histogram": chartdata.histogram(trimmed),
        "pace_density": chartdata.density(trimmed, tasks=tasks),
        "pace_histogram_shared": chartdata.histogram(
            trimmed, bins=chartdata.SHARED_BINS, shared_range=True
        ),
        "pace_density_shared": chartdata.density(trimmed, shared_range=True, tasks=tasks),
    }
    if shifts:
        dow_tod = profile.dow_tod_profile(base)
        tables |= {
            "pace_by_tod": profile.tod_profile(base),
            "pace_by_dow_tod": chartdata.dow_tod_bars(dow_tod),
            "pace_trend_by_tod": chartdata.trend_by_tod(dow_tod),
        }
    return tables


def _finished(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def _signature(deliveries: DataFrame) -> str:
    """The files the deliveries are read from, their state, and what is done with them."""
    plan = deliveries._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    files = map(str, file_states(deliveries.sparkSession, deliveries.inputFiles()))
    text = "\n".join([*files, re.sub(r"#\d+L?", "", plan)])
    return hashlib.sha256(text.encode()).hexdigest()


def _written(table: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> DataFrame:
    spark = table.sparkSession
    if not _finished(spark, path):
        write(table, path)
    return spark.read.schema(table.schema).parquet(path)


def _plain(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def _by_campaign(table: DataFrame, path: str) -> None:
    # One folder per campaign, so that a reader of one skips the others.
    table.write.mode("overwrite").partitionBy(*CAMPAIGN_FOLDERS).parquet(path)


def _balanced(table: DataFrame, path: str) -> None:
    land_by_campaign(table, path, balance=True, mode="overwrite")


def write_report(deliveries: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Write every table of canonical ``deliveries`` under ``folder``; return them as read back.

    Without ``delivered_ts`` the tables of shifts are left out. A folder that holds the report of
    other deliveries, or of files that have changed since, is refused.
    """
    spark = deliveries.sparkSession
    folder = folder.rstrip("/")
    signed = spark.range(1).selectExpr(f"'{_signature(deliveries)}' AS signature")
    if _written(signed, f"{folder}/{INPUT}", _plain).first() != signed.first():
        raise ValueError(f"{folder} holds the report of other deliveries")

    shifts = "delivered_ts" in deliveries.columns
    features = time_features(deliveries) if shifts else deliveries
    counts = pace.count_enumerator_days(features, by_shift=shifts)
    days = _written(counts, f"{folder}/{ENUMERATOR_DAYS}", _by_campaign)
    return {ENUMERATOR_DAYS: days} | write_tables(days, folder, shifts)


def write_tables(days: DataFrame, folder: str, shifts: bool = True) -> dict[str, DataFrame]:
    """Write every table that follows from the counts per enumerator and day."""
    daily = pace.iqr_trim(pace.average_days(days))
    trimmed = _written(daily, f"{folder}/{DAILY_PACE}", _balanced)
    base = _written(profile.profile_base(days), f"{folder}/{PROFILE_BASE}", _plain)

    # The days are written, so counting them reads no column.
    tasks = chartdata.curve_tasks(trimmed.count())
    written = {DAILY_PACE: trimmed, PROFILE_BASE: base}
    for name, table in report_tables(base, trimmed, shifts, tasks).items():
        written[name] = _written(table, f"{folder}/{name}", _plain)
    return written
