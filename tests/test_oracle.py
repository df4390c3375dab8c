"""Every registered query against its SQL, on both small scale factors."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures
from checks.oracle import KEYS, MISSING, UNEVEN, _with, oracle_sql
from checks.queries import queries
from fieldtempo import functions
from fieldtempo.operators import normalize, pace
from tests.oracle_compare import connect, differences, duckdb_rows, spark_rows

QUERIES = queries()
ORACLE = oracle_sql()
SF_DIRS = {name: f"/root/testdata/{name}" for name in ("sf0.001", "sf0.01")}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize(
    "fixture, least",
    [
        (fixtures.events_uneven, 18),
        (fixtures.events_with_missing, 18),
        (fixtures.lineitem_pace, 300),
        (fixtures.orders_pace, 1000),
    ],
)
def test_the_trim_drops_days_of_every_fixture_it_is_compared_on(spark, fixture, least):
    daily = pace.daily_pace(fixture(spark, SF_DIRS["sf0.01"]))
    assert daily.count() - pace.iqr_trim(daily).count() >= least


@pytest.fixture(scope="session")
def connections():
    return {name: connect(folder) for name, folder in SF_DIRS.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.parametrize("sf", sorted(SF_DIRS))
def test_query_matches_sql(spark, connections, sf, name):
    result = spark_rows(QUERIES[name](spark, SF_DIRS[sf]))
    expected = duckdb_rows(connections[sf], ORACLE[name])
    assert result[1], "an empty result would match anything"
    assert differences(result, expected) == []


TYPED = {
    "parse_iso": (
        lambda spark, sf: functions.parse_iso(
            fixtures.events_text(spark, sf).select(
                "event_id", F.concat(F.regexp_replace("iso_text", "[Z+].*", ""), F.lit(".25Z")).alias("t")
            ),
            "t",
            "delivered_ts",
        ).drop("t"),
        "SELECT event_id, CASE WHEN event_id % 10 <> 7 THEN date_trunc('second', ts) + INTERVAL 250 MILLISECOND "
        "END AS delivered_ts FROM events",
    ),
    "time_features": (
        lambda spark, sf: normalize.time_features(
            fixtures.events_with_missing(spark, sf).select("event_id", "delivered_ts")
        ).drop("dow", "tod"),
        f"""SELECT event_id, delivered_ts, CAST(delivered_ts AS DATE) AS date,
            CAST(hour(delivered_ts) AS INTEGER) AS hour,
            CAST(dayofweek(delivered_ts) + 1 AS INTEGER) AS dow_order FROM ({MISSING})""",
    ),
    "all_daily_pace": (
        lambda spark, sf: pace.all_daily_pace(fixtures.events_uneven(spark, sf)),
        _with(UNEVEN, f"SELECT {KEYS}, date, daily_avg, Q1, Q3, Q3 - Q1 AS IQR FROM trimmed"),
    ),
    "enumerator_daily_counts": (
        lambda spark, sf: pace.enumerator_daily_counts(fixtures.events_with_missing(spark, sf)),
        _with(MISSING, f"SELECT {KEYS}, date, enumerator, enum_daily_deliv FROM counts"),
    ),
}


@pytest.mark.parametrize("name", sorted(TYPED))
def test_values_keep_their_types(spark, connections, name):
    """Dates, timestamps with fractions and integers as such, not as text."""
    build, sql = TYPED[name]
    result = spark_rows(build(spark, SF_DIRS["sf0.01"]))
    assert result[1]
    assert differences(result, duckdb_rows(connections["sf0.01"], sql)) == []


def test_the_date_range_drops_and_keeps_rows(spark):
    whole = QUERIES["parse_mixed_formats"](spark, SF_DIRS["sf0.01"])
    picked = QUERIES["parse_mixed_date_range"](spark, SF_DIRS["sf0.01"]).count()
    assert 0 < picked < whole.where("delivered_ts is not null").count()
