"""Parquet tables partitioned by campaign."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldtempo.sources.csv_files import read_campaigns
from fieldtempo.sources.manifest import Source

CAMPAIGN_FOLDERS = ("city", "year")
#: The folder that tells what has become of a row's date text, and its names.
DATE_STATE = "date_text"
READ, MISSING, BAD = "read", "missing", "bad"


def land_by_campaign(
    table: DataFrame, path: str, balance: bool = False, mode: str = "error"
) -> None:
    """Write ``table`` under ``path``, one folder per city and year.

    Rows read from campaign files need no shuffle: a scan task holds files of few campaigns, and
    writes a file for each. After a shuffle every task holds every campaign; ``balance`` then gathers the rows of a
    campaign, and adaptive execution splits the campaigns that are too large for one task. Without
    adaptive execution nothing would split them, so balancing is refused.
    """
    if balance:
        if table.sparkSession.conf.get("spark.sql.adaptive.enabled") != "true":
            raise ValueError("balancing by campaign needs spark.sql.adaptive.enabled")
        table = table.hint("rebalance", *CAMPAIGN_FOLDERS)
    table.write.mode(mode).partitionBy(*CAMPAIGN_FOLDERS).parquet(path)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Landed:
    """What one landing has written, counted as it was written."""

    rows: int
    missing_dates: int
    bad_dates: int


def land_campaigns(
    spark: SparkSession, sources: Iterable[Source], path: str, mode: str = "error"
) -> Landed:
    """Read campaign files and write them under ``path``, each date text being parsed once.

    Below city and year, rows lie by what has become of their date text. So the texts that could not
    be read are a small table of their own, which ``landed_bad_dates`` reads without the other rows,
    and neither it nor a report over the landed rows parses anything again.
    """
    text, time = F.col("delivered_raw"), F.col("delivered_ts")
    state = F.when(time.isNotNull(), READ).when(text.isNull(), MISSING).otherwise(BAD)
    deliveries = read_campaigns(spark, sources).withColumn(DATE_STATE, state)
    seen = Observation("landed")
    observed = deliveries.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(DATE_STATE) == MISSING).alias("missing"),
        F.count_if(F.col(DATE_STATE) == BAD).alias("bad"),
    )
    observed.write.mode(mode).partitionBy(*CAMPAIGN_FOLDERS, DATE_STATE).parquet(path)
    counts = seen.get
    return Landed(counts["rows"], counts["missing"], counts["bad"])


def landed_date_states(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each campaign by what has become of their date text; no column is read for it."""
    return read_landed(spark, path).groupBy(*CAMPAIGN_FOLDERS, DATE_STATE).agg(
        F.count(F.lit(1)).alias("deliveries")
    )


def landed_bad_dates(spark: SparkSession, path: str) -> DataFrame:
    """The distinct texts of each campaign that are present but could not be read."""
    bad = read_landed(spark, path).where(F.col(DATE_STATE) == BAD)
    return bad.select(*CAMPAIGN_FOLDERS, "delivered_raw").distinct()
