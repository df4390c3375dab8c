"""The driver's tables read as deliveries.

Each mapping covers its whole table. ``year`` comes from the date here because these tables have no
campaign label; in campaign files it is a label of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.scratch import finish, kept_path
from fieldtempo.sources import CAMPAIGNS, MIXED_KM, Source

# The text columns of a day-first or mixed campaign file, as its headers spell them.
TEAM_HEADERS = {
    "time_delivery_date": "Time Delivery Date",
    "enteredby": "Enteredby",
    "time_gps_distance_original": "Time GPS Distance (Original)",
    "property_type": "Property Type",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def city(key: Column) -> Column:
    return F.when(key % 3 == 0, "Freetown").when(key % 3 == 1, "Kenema").otherwise("Makeni")


def events_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        city(F.col("user_id")).alias("city"),
        F.year(ts).alias("year"),
        F.col("user_id").alias("enumerator"),
        ts.alias("delivered_ts"),
        F.to_date(ts).alias("date"),
        F.col("value").alias("distance"),
        F.lit(80.0).alias("threshold"),
    )


def events_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events; every ninth day few enumerators do all the work, so the trim has days to drop."""
    busy_day = F.dayofmonth("date") % 9 == 4
    enumerator = F.when(busy_day, F.col("enumerator") % 15).otherwise(F.col("enumerator"))
    return events_pace(spark, sf_dir).withColumn("enumerator", enumerator)


def events_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing distances, dates and enumerators."""
    key = F.col("event_id")
    deliveries = events_uneven(spark, sf_dir)
    return deliveries.withColumns(
        {
            "distance": F.when(key % 13 != 0, F.col("distance")),
            "delivered_ts": F.when(key % 17 != 0, F.col("delivered_ts")),
            "date": F.when(key % 17 != 0, F.col("date")),
            "enumerator": F.when(key % 19 != 0, F.col("enumerator")),
        }
    )


def lineitem_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.to_date("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        city(F.col("l_suppkey")).alias("city"),
        F.year(date).alias("year"),
        F.col("l_suppkey").alias("enumerator"),
        date.alias("date"),
        F.col("l_quantity").cast("double").alias("distance"),
        F.lit(40.0).alias("threshold"),
    )


def orders_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        city(F.col("o_custkey")).alias("city"),
        F.year(date).alias("year"),
        F.col("o_orderpriority").alias("enumerator"),
        date.alias("date"),
        F.col("o_totalprice").alias("distance"),
        F.lit(400000.0).alias("threshold"),
    )


def _format(pattern: str) -> Column:
    return F.date_format("ts", pattern)


def _dotted_half() -> Column:
    return F.when(F.hour("ts") < 12, "a.m.").otherwise("p.m.")


def mixed_text() -> Column:
    """Delivery time as text in four orders, some of each with markers, two-digit years, fractions,
    month names or no separators, and some that is no time at all."""
    key = F.col("event_id")
    return (
        F.when(key % 8 == 3, "rejected")
        .when(key % 32 == 2, F.concat(_format("dd/MM/yyyy HH:mm:ss"), F.lit(" WAT")))
        .when(key % 16 == 4, _format("dd/MM/yyyy hh:mm:ss a"))
        .when(key % 16 == 8, _format("dd-MMM-yyyy HH:mm:ss"))
        .when(key % 16 == 12, _format("dd/MM/yy HH:mm:ss"))
        .when(key % 4 == 0, _format("dd/MM/yyyy HH:mm:ss"))
        .when(key % 16 == 5, _format("MM/dd/yyyy HH:mm:ss.SSS"))
        .when(key % 16 == 9, _format("MMddyyyy HHmmss"))
        .when(key % 4 == 1, _format("MM/dd/yyyy HH:mm:ss"))
        .when(key % 16 == 6, F.concat(_format("dd/MM/yyyy hh:mm "), _dotted_half()))
        .when(key % 4 == 2, _format("dd/MM/yyyy HH:mm"))
        .when(key % 16 == 7, _format("MMM dd yyyy HH:mm"))
        .otherwise(_format("MM/dd/yyyy HH:mm"))
    )


def multi_text() -> Column:
    """A multi-value column: missing, one value, or three."""
    key = F.col("event_id")
    kind = F.col("event_type")
    return F.when(
        key % 11 != 0,
        F.when(key % 3 == 0, F.concat(kind, F.lit(", annex,"), kind)).otherwise(kind),
    )


def events_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time as text in the formats of every layout."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "value",
        F.when(key % 10 == 7, "not a date")
        .when(key % 10 == 3, _format("yyyy-MM-dd HH:mm:ss"))
        .when(key % 10 == 5, _format("yyyy-MM-dd'T'HH:mm:ss'+02'"))
        .otherwise(_format("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("iso_text"),
        F.when(key % 10 == 7, _format("dd.MM HH"))
        .when(key % 10 == 5, _format("M/d/yyyy h:mm a"))
        .when(key % 10 == 1, _format("M/d/yy H:mm"))
        .when(key % 10 == 9, _format("MMM d yyyy H:mm"))
        .otherwise(_format("M/d/yyyy H:mm"))
        .alias("mdy_text"),
        mixed_text().alias("mixed_text"),
        F.when(key % 17 != 0, mixed_text()).alias("mixed_or_missing"),
        multi_text().alias("multi_text"),
    )


def _write_csv(frame: DataFrame, path: str, *folders: str) -> None:
    writer = frame.write.option("header", True).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False)
    writer = writer.option("ignoreTrailingWhiteSpace", False)
    if folders:
        writer = writer.partitionBy(*folders)
    writer.mode("overwrite").csv(path)


def _team_columns() -> list[Column]:
    """Columns of a team file: padded, empty and ``NA`` fields, quoted lists."""
    key = F.col("event_id")
    time = F.col("mixed_or_missing")
    padded = F.concat(F.lit("  "), time, F.lit(" "))
    return [
        F.when(key % 5 == 0, padded).otherwise(time).alias("time_delivery_date"),
        F.concat(F.lit("user "), F.col("user_id")).alias("enteredby"),
        F.when(key % 13 == 0, "NA")
        .otherwise((F.col("value") / 1000).cast("string"))
        .alias("time_gps_distance_original"),
        F.col("multi_text").alias("property_type"),
    ]


def team_csv(spark: SparkSession, sf_dir: str) -> Source:
    """One campaign in one CSV folder, written from the whole events table."""
    path, finished = kept_path(spark, "team-csv", sf_dir)
    if not finished:
        team = events_text(spark, sf_dir).select(*_team_columns())
        _write_csv(team.toDF(*TEAM_HEADERS.values()), path)
        finish(spark, path)
    return Source("Freetown", 2024, MIXED_KM, (path,))


def two_team_csv(spark: SparkSession, sf_dir: str) -> Source:
    """One campaign in two CSV folders; the second has other header positions and no types."""
    folder, finished = kept_path(spark, "two-teams", sf_dir)
    if not finished:
        text = events_text(spark, sf_dir).select("event_id", *_team_columns())
        first = text.where(F.col("event_id") % 2 == 0).select(*TEAM_HEADERS)
        second = text.where(F.col("event_id") % 2 == 1).select(
            "time_gps_distance_original", "enteredby", "time_delivery_date"
        )
        _write_csv(first.toDF(*TEAM_HEADERS.values()), f"{folder}/team_1-3")
        _write_csv(second, f"{folder}/team_4-6")
        finish(spark, folder)
    return Source("Freetown", 2024, MIXED_KM, (f"{folder}/team_1-3", f"{folder}/team_4-6"))


def uneven_headers_csv(spark: SparkSession, sf_dir: str) -> str:
    """One folder whose sub-folders, named like partitions, hold files of other headers: reordered,
    repeated, empty, and with columns missing."""
    folder, finished = kept_path(spark, "uneven-headers", sf_dir)
    if not finished:
        key, kind = F.col("event_id"), F.col("event_type")
        rows = table(spark, sf_dir, "events").select(key.cast("string"), kind, "user_id")
        parts = [
            (["Note", "note", "Key"], [kind, F.lit("other"), key]),
            (["note", "Note", "Key"], [kind, F.lit("other"), key]),
            (["Key", "", "Note"], [key, F.lit("unnamed"), kind]),
            (["Key", "User"], [key, F.concat(F.lit("user "), F.col("user_id"))]),
        ]
        for n, (headers, columns) in enumerate(parts):
            named = [c.alias(f"c{i}") for i, c in enumerate(columns)]
            part = rows.where(key.cast("bigint") % 4 == n).select(*named)
            # Spark refuses to write repeated headers, so they are a line of text before the first
            # row of each task, which writes a file of its own.
            place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
            line, header = F.concat_ws(",", *part.columns), F.lit(",".join(headers))
            lines = part.select(place.alias("place"), line.alias("line"))
            text = F.when(F.col("place") == 0, F.array(header, "line")).otherwise(F.array("line"))
            lines.select(F.explode(text).alias("value")).write.mode("overwrite").text(
                f"{folder}/files/part={n}"
            )
        finish(spark, folder)
    return f"{folder}/files/*"


# The known campaigns, each dealt the events of the users whose ``user_id % 8`` is its position.
MANIFEST = [(city_name, year, layout) for city_name, year, layout, _ in CAMPAIGNS]


def _write_manifest(spark: SparkSession, sf_dir: str, folder: str) -> None:
    campaign = F.col("user_id") % 8
    text = events_text(spark, sf_dir)
    iso = text.where(campaign == 0).select(
        F.col("iso_text").alias("Delivered On"),
        F.col("user_id").alias("Mobile User: Username"),
        F.col("value").alias("Distance"),
    )
    month_first = text.where(campaign == 1).select(
        F.col("mdy_text").alias("deliveredOn"),
        F.col("user_id").alias("User Name"),
        F.col("value").alias("distance"),
    )
    teams = text.where(campaign >= 2).select(
        campaign.alias("campaign"), (F.col("event_id") % 2).alias("team"), *_team_columns()
    )
    _write_csv(iso, f"{folder}/iso")
    _write_csv(month_first, f"{folder}/month_first")
    _write_csv(teams, f"{folder}/teams", "campaign", "team")


def manifest_csv(spark: SparkSession, sf_dir: str) -> list[Source]:
    """Eight campaigns in the five layouts, together the whole events table."""
    folder, finished = kept_path(spark, "manifest", sf_dir)
    if not finished:
        _write_manifest(spark, sf_dir, folder)
        finish(spark, folder)

    def paths(number: int) -> tuple[str, ...]:
        if number < 2:
            return (f"{folder}/{('iso', 'month_first')[number]}",)
        one_file = MANIFEST[number][:2] == ("Kenema", 2024)
        teams_of = f"{folder}/teams/campaign={number}"
        return (teams_of,) if one_file else (f"{teams_of}/team=0", f"{teams_of}/team=1")

    return [
        Source(city_name, year, layout, paths(number))
        for number, (city_name, year, layout) in enumerate(MANIFEST)
    ]
