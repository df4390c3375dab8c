"""Header names, timestamps, shifts and weekdays."""

import datetime

import pytest
from pyspark.sql import functions as F

from fieldtempo.functions import (
    NIGHT_SHIFT,
    parse_dmy_hms,
    parse_iso,
    parse_mdy_hm,
    parse_mixed,
    shift,
    snake_case_names,
    weekday,
    weekday_order,
)


@pytest.mark.parametrize(
    "headers, names",
    [
        (["Delivered On", "Mobile User: Username"], ["delivered_on", "mobile_user_username"]),
        (["deliveredOn", "GPSDistance"], ["delivered_on", "gps_distance"]),
        (["time_delivery_date", " enteredby "], ["time_delivery_date", "enteredby"]),
        (["Share %", "House #", "Owner's Name"], ["share_percent", "house_number", "owners_name"]),
        (["Total", "total", "TOTAL"], ["total", "total_2", "total_3"]),
        (["a", "A 2", "a"], ["a", "a_2", "a_3"]),
        (["2024 count", "", "Zoné"], ["x2024_count", "x", "zone"]),
    ],
)
def test_snake_case_names(headers, names):
    assert snake_case_names(headers) == names
    assert snake_case_names(names) == names


def parse_all(spark, parse, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parsed = parse(frame, "t", "ts")
    assert parsed.columns == ["i", "t", "ts"]
    return [row.ts for row in parsed.orderBy("i").collect()]


def at(*parts):
    return datetime.datetime(*parts)


def test_parse_dmy_hms(spark):
    cases = {
        "14/03/2024 09:05:00": at(2024, 3, 14, 9, 5),
        "14-3-2024   9:05:07": at(2024, 3, 14, 9, 5, 7),
        "14.03.24 09.05.00": at(2024, 3, 14, 9, 5),
        "01/02/75 09:05:00": at(1975, 2, 1, 9, 5),
        "14/03/2024 09:05:00 PM": at(2024, 3, 14, 21, 5),
        "14/03/2024 12:05:00 am": at(2024, 3, 14, 0, 5),
        "14/03/2024 12:05:00 PM": at(2024, 3, 14, 12, 5),
        "14/03/2024 09:05:00.250": at(2024, 3, 14, 9, 5),
        "14/03/2024 09:05:00 p.m.": at(2024, 3, 14, 21, 5),
        "14/03/2024 09:05:00 P.M": at(2024, 3, 14, 21, 5),
        "14/03/2024 09:05:00PM": at(2024, 3, 14, 21, 5),
        "14/03/2024 09:05:00 PM GMT": at(2024, 3, 14, 21, 5),
        "14/03/2024 09:05:00 UTC": at(2024, 3, 14, 9, 5),
        "14/03/2024 09:05:00 PM WAT": None,
        "14/03/2024 09:05:00 WAT": None,
        "14/03/2024 09:05:00 P": None,
        "PM 14/03/2024 09:05:00": None,
        "14/03/2024 00:05:00 PM": None,
        "14/03/2024 13:05:00 PM": None,
        "14/03/2024 09:05:00 +0200": at(2024, 3, 14, 7, 5),
        "14/03/2024 09:05:00-0330": at(2024, 3, 14, 12, 35),
        "14/03/2024 09:05:00.5+02": at(2024, 3, 14, 7, 5),
        "14-Mar-2024 09:05:00": at(2024, 3, 14, 9, 5),
        "14 march 2024, 09:05:00 pm": at(2024, 3, 14, 21, 5),
        "14Sept2024T09:05:00Z": at(2024, 9, 14, 9, 5),
        "Mar 14 2024 09:05:00": None,
        "Mar 5 2024 09:05:00": None,
        "14 Mars 2024 09:05:00": None,
        "Thu 14/03/2024 09:05:00": None,
        "14032024 090500": at(2024, 3, 14, 9, 5),
        "14032024090507": at(2024, 3, 14, 9, 5, 7),
        "14032024 0905": None,
        "140324 090500": None,
        "29/02/2024 00:00:00": at(2024, 2, 29),
        "29/02/2023 00:00:00": None,
        "03/14/2024 09:05:00": None,
        "14/03/2024 09:05": None,
        "14/03/2024": None,
        "14/03/202 09:05:00": None,
        "14/03/2024 24:05:00": None,
        "14/03/2024 09:60:00": None,
        "2024-03-14 09:05:00": None,
        "99999999999/03/2024 09:05:00": None,
        "rejected": None,
        "": None,
        None: None,
    }
    assert parse_all(spark, parse_dmy_hms, list(cases)) == list(cases.values())


def test_parse_mdy_hm(spark):
    cases = {
        "3/14/2025 9:05": at(2025, 3, 14, 9, 5),
        "03/04/2025 23:59": at(2025, 3, 4, 23, 59),
        "3/14/25 9:05 PM": at(2025, 3, 14, 21, 5),
        "14/3/2025 9:05": None,
        "3/14/2025 9:05 p.m.": at(2025, 3, 14, 21, 5),
        "3/14/2025 0:05 PM": None,
        "Mar 14 2025 9:05": at(2025, 3, 14, 9, 5),
        "14 Mar 2025 9:05": None,
        "03142025 0905": at(2025, 3, 14, 9, 5),
        "3/14/2025 9:05:00": None,
        None: None,
    }
    assert parse_all(spark, parse_mdy_hm, list(cases)) == list(cases.values())


def test_parse_mixed_takes_the_first_order_that_fits(spark):
    cases = {
        "14/03/2023 09:05:00": at(2023, 3, 14, 9, 5),
        "03/14/2023 09:05:00": at(2023, 3, 14, 9, 5),
        "14/03/2023 09:05": at(2023, 3, 14, 9, 5),
        "03/14/2023 09:05": at(2023, 3, 14, 9, 5),
        "03/04/2023 09:05": at(2023, 4, 3, 9, 5),
        "31/02/2023 09:05": None,
        "Mar 5 2023 09:05": at(2023, 3, 5, 9, 5),
        "5 Mar 2023 09:05:00": at(2023, 3, 5, 9, 5),
        "03142023 0905": at(2023, 3, 14, 9, 5),
        "rejected": None,
    }
    assert parse_all(spark, parse_mixed, list(cases)) == list(cases.values())


def test_parse_iso(spark):
    cases = {
        "2025-03-04T10:05:00Z": at(2025, 3, 4, 10, 5),
        " 2025-03-04 10:05:00 ": at(2025, 3, 4, 10, 5),
        "2025-03-04T10:05:00.500Z": at(2025, 3, 4, 10, 5, 0, 500000),
        "2025-03-04T10:05:00+02:00": at(2025, 3, 4, 8, 5),
        "2025-03-04T22:05:00-0330": at(2025, 3, 5, 1, 35),
        "2025-03-04T10:05:00+02": at(2025, 3, 4, 8, 5),
        "2025-03-04 10:05:00 -02": at(2025, 3, 4, 12, 5),
        "2025-03-04": at(2025, 3, 4),
        "2025": None,
        "10:05": None,
        "2025-13-04 10:05:00": None,
        "not a date": None,
        None: None,
    }
    assert parse_all(spark, parse_iso, list(cases)) == list(cases.values())


def test_parsing_ignores_the_session_time_zone(spark):
    texts = ["2025-03-30T01:30:00Z", "2025-03-30 02:30:00"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        expected = [at(2025, 3, 30, 1, 30), at(2025, 3, 30, 2, 30)]
        assert parse_all(spark, parse_iso, texts) == expected
        assert parse_all(spark, parse_dmy_hms, ["30/03/2025 02:30:00"]) == [at(2025, 3, 30, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_shift_brackets(spark):
    hours = [0, 5, 6, 8, 9, 11, 12, 14, 15, 17, 18, 23, None]
    frame = spark.createDataFrame([(i, h) for i, h in enumerate(hours)], "i int, h int")
    labels = [r.s for r in frame.select("i", shift(F.col("h")).alias("s")).orderBy("i").collect()]
    day_shifts = [s for s in ("06–08", "09–11", "12–14", "15–17") for _ in range(2)]
    assert labels == [NIGHT_SHIFT, NIGHT_SHIFT, *day_shifts, NIGHT_SHIFT, NIGHT_SHIFT, NIGHT_SHIFT]


def test_weekdays_start_on_sunday(spark):
    frame = spark.sql("select explode(sequence(date'2024-01-07', date'2024-01-13')) as d")
    rows = frame.select(weekday_order(F.col("d")), weekday(F.col("d"))).orderBy("d").collect()
    labels = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
    assert [tuple(row) for row in rows] == list(enumerate(labels, 1))
