"""Registered queries, in a form that compares with SQL: doubles rounded, dates as text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import fixtures
from checks.scratch import kept_path, scratch_path
from fieldtempo import functions
from fieldtempo.operators import chartdata, normalize, pace, profile, stats
from fieldtempo.plans import write_report
from fieldtempo.sources import (
    file_headers,
    file_states,
    land_by_campaign,
    read_campaigns,
    read_csv,
    read_landed,
    read_source,
)

Query = Callable[[SparkSession, str], DataFrame]

DECIMALS = 6

# Whole numbers that may be missing; some clients turn such columns into floats.
AS_TEXT = {"enumerator", "hour", "dow_order"}


def comparable(result: DataFrame) -> DataFrame:
    columns = []
    for field in result.schema:
        column = F.col(field.name)
        if field.name in AS_TEXT:
            column = column.cast("string")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, DECIMALS)
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        columns.append(column.alias(field.name))
    return result.select(*columns)


def trimmed(fixture: Query) -> Query:
    return lambda spark, sf_dir: pace.all_daily_pace(fixture(spark, sf_dir))


def over(fixture: Query, *steps: Callable[[DataFrame], DataFrame]) -> Query:
    """The steps, in order, over a fixture."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = fixture(spark, sf_dir)
        for step in steps:
            frame = step(frame)
        return comparable(frame)

    return query


def _parsed(column: str, parse: Callable) -> Callable[[DataFrame], DataFrame]:
    return lambda df: parse(df.select("event_id", column), column, "delivered_ts").drop(column)


def _scanned(df: DataFrame) -> DataFrame:
    distance = "time_gps_distance_original"
    return df.drop("source").withColumn(distance, F.col(distance).try_cast("double"))


def _named_source(df: DataFrame) -> DataFrame:
    """The file's folder, as far as it does not change from run to run."""
    folder = r"(iso|month_first|teams/campaign=\d+/team=\d+)/[^/]+$"
    return df.withColumn("source", F.regexp_extract("source", folder, 1))


def _csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_csv(spark, fixtures.uneven_headers_csv(spark, sf_dir))
    return files.withColumn("source", F.regexp_extract("source", r"(part=\d+)/", 1))


def _csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_source(spark, fixtures.team_csv(spark, sf_dir))


def _multi_file_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_source(spark, fixtures.two_team_csv(spark, sf_dir))


def _campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_campaigns(spark, fixtures.manifest_csv(spark, sf_dir))


def _date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date texts of the campaigns whose rows are split, as read, before the split."""
    sources = fixtures.manifest_csv(spark, sf_dir)
    headers = file_headers(spark, [path for source in sources for path in source.paths])
    frames = [
        read_source(spark, source, headers).select(
            F.lit(source.city).alias("city"),
            F.lit(source.year).alias("year"),
            F.col(source.layout.delivered).alias("delivered_raw"),
        )
        for source in sources
        if source.layout.property_type
    ]
    return reduce(DataFrame.unionByName, frames)


def _in_range(column: str) -> Callable[[DataFrame], DataFrame]:
    """Some days of a year: what a user picks first."""
    return lambda df: df.where(
        f"""{column} IS NOT NULL AND year({column}) = 2024
            AND {column} >= timestamp_ntz'2024-01-10' AND {column} < timestamp_ntz'2024-01-21'"""
    )


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "landed")
    land_by_campaign(fixtures.events_uneven(spark, sf_dir), path, balance=True)
    return read_landed(spark, path)


def _report(table: str) -> Query:
    """A table of the report; the first one asked for writes it, the others find it finished.

    What it costs is that of the report as a whole, which the bench times. Input that has changed gets
    another folder.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        deliveries = fixtures.events_uneven(spark, sf_dir)
        state = repr(file_states(spark, deliveries.inputFiles()))
        return write_report(deliveries, kept_path(spark, "report", state)[0])[table]

    return query


REPORT_TABLES = (
    "pace_stats summary_all accuracy_comparison pace_by_tod pace_by_dow pace_by_dow_tod "
    "pace_trend_by_tod pace_timeseries pace_histogram pace_density pace_histogram_shared "
    "pace_density_shared"
).split()


def _missing_date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fixtures.events_text(spark, sf_dir)
    kept = normalize.drop_missing_dates(text, raw="mixed_or_missing")
    return kept.select("event_id", "mixed_or_missing")


def _split_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily pace where every listed property type is a delivery."""
    deliveries = fixtures.table(spark, sf_dir, "events").select(
        fixtures.city(F.col("user_id")).alias("city"),
        F.year("ts").alias("year"),
        F.to_date("ts").alias("date"),
        F.col("user_id").alias("enumerator"),
        F.col("value").alias("distance"),
        F.lit(80.0).alias("threshold"),
        fixtures.multi_text().alias("property_type"),
    )
    return pace.daily_pace(normalize.split_multivalue(deliveries))


def queries() -> dict[str, Query]:
    events = fixtures.events_pace
    uneven = fixtures.events_uneven
    missing = fixtures.events_with_missing
    lineitem = fixtures.lineitem_pace
    orders = fixtures.orders_pace
    text = fixtures.events_text

    def shared_histogram(df: DataFrame) -> DataFrame:
        return chartdata.histogram(df, bins=chartdata.SHARED_BINS, shared_range=True)

    def shared_density(df: DataFrame) -> DataFrame:
        return chartdata.density(df, shared_range=True)

    return {
        # Sources
        "csv_scan": over(_csv_scan, _scanned),
        "multi_file_union": over(_multi_file_union, _scanned),
        "csv_uneven_headers": over(_csv_headers),
        "canonical_deliveries": over(_campaigns, _named_source),
        "campaign_summary": over(_campaigns, pace.all_daily_pace, stats.summary_all),
        "campaign_accuracy_comparison": over(
            _campaigns, pace.all_daily_pace, stats.accuracy_comparison
        ),
        "campaign_date_range_summary": over(
            _campaigns, _in_range("delivered_ts"), pace.all_daily_pace, stats.summary_all
        ),
        "campaign_bad_dates": over(
            _date_texts, lambda df: normalize.bad_dates(df, keys=pace.CAMPAIGN)
        ),
        "campaign_pace_dow_tod": over(
            _campaigns, normalize.time_features, profile.pace_by_dow_tod, chartdata.dow_tod_bars
        ),
        "landed_daily_pace": over(_landed, pace.daily_pace),
        # Cleaning
        "accuracy_filter": over(missing, normalize.accuracy_filter),
        "missing_date_filter": over(_missing_date_filter),
        "split_multivalue": over(
            text,
            lambda df: normalize.split_multivalue(
                df.select("event_id", F.col("multi_text").alias("property_type"))
            ),
        ),
        "parse_iso": over(text, _parsed("iso_text", functions.parse_iso)),
        "parse_mdy_hm": over(text, _parsed("mdy_text", functions.parse_mdy_hm)),
        "parse_dmy_hms": over(text, _parsed("mixed_text", functions.parse_dmy_hms)),
        "parse_mixed_formats": over(text, _parsed("mixed_text", functions.parse_mixed)),
        "parse_mixed_date_range": over(
            text, _parsed("mixed_text", functions.parse_mixed), _in_range("delivered_ts")
        ),
        "bad_dates": over(text, lambda df: normalize.bad_dates(df, raw="mixed_or_missing")),
        "time_features": over(
            missing,
            lambda df: normalize.time_features(df.select("event_id", "delivered_ts")),
        ),
        # Pace
        "enumerator_daily_counts": over(missing, pace.enumerator_daily_counts),
        "daily_pace": over(missing, pace.daily_pace),
        "split_daily_pace": over(_split_pace),
        "iqr_trim": over(lineitem, pace.daily_pace, pace.iqr_trim),
        "all_daily_pace": over(trimmed(uneven)),
        "all_daily_pace_with_missing": over(trimmed(missing)),
        "all_daily_pace_orders": over(trimmed(orders)),
        # Benchmarks
        "pace_stats": over(trimmed(uneven), stats.pace_stats),
        "pace_stats_lineitem": over(trimmed(lineitem), stats.pace_stats),
        "pace_stats_orders": over(trimmed(orders), stats.pace_stats),
        "summary_all": over(trimmed(uneven), stats.summary_all),
        "summary_all_lineitem": over(trimmed(lineitem), stats.summary_all),
        "accuracy_comparison": over(trimmed(uneven), stats.accuracy_comparison),
        "accuracy_comparison_lineitem": over(trimmed(lineitem), stats.accuracy_comparison),
        # Profiles
        "pace_by_tod": over(missing, normalize.time_features, profile.pace_by_tod),
        "pace_by_dow": over(missing, normalize.time_features, profile.pace_by_dow),
        "pace_by_dow_tod": over(missing, normalize.time_features, profile.pace_by_dow_tod),
        "all_pace_dow_tod": over(
            events, normalize.time_features, profile.pace_by_dow_tod, chartdata.dow_tod_bars
        ),
        "pace_trend_by_tod": over(
            uneven, normalize.time_features, profile.pace_by_dow_tod, chartdata.trend_by_tod
        ),
        # Chart tables
        "pace_timeseries": over(trimmed(uneven), chartdata.timeseries),
        "pace_histogram": over(trimmed(uneven), chartdata.histogram),
        "pace_histogram_lineitem": over(trimmed(lineitem), chartdata.histogram),
        "pace_histogram_orders": over(trimmed(orders), chartdata.histogram),
        "pace_histogram_faceted": over(trimmed(uneven), shared_histogram),
        "pace_histogram_faceted_lineitem": over(trimmed(lineitem), shared_histogram),
        "pace_density": over(trimmed(uneven), chartdata.density),
        "pace_density_orders": over(trimmed(orders), chartdata.density),
        "pace_density_faceted": over(trimmed(uneven), shared_density),
        # The whole report from one pass
        **{f"report_{name}": over(_report(name)) for name in REPORT_TABLES},
    }
