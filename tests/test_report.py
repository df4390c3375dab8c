"""The one-pass report, and rules that hold on any deliveries."""

import datetime
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from checks import fixtures
from checks.queries import comparable
from checks.scratch import scratch_path
from fieldtempo import session
from fieldtempo.operators import chartdata, normalize, pace, profile, stats
from fieldtempo.plans import write_report
from fieldtempo.session import cluster_conf, first_partitions
from fieldtempo.sources import land_by_campaign
from tests.frames import deliveries
from tests.oracle_compare import differences, spark_rows

SF_DIR = "/root/testdata/sf0.001"


def test_report_equals_the_direct_results(spark, tmp_path):
    events = fixtures.events_with_missing(spark, SF_DIR)
    report = write_report(events, str(tmp_path / "report"))
    features = normalize.time_features(events)
    trimmed = pace.all_daily_pace(events)
    direct = {
        "all_daily_pace": trimmed,
        "pace_stats": stats.pace_stats(trimmed),
        "summary_all": stats.summary_all(trimmed),
        "accuracy_comparison": stats.accuracy_comparison(trimmed),
        "pace_by_tod": profile.pace_by_tod(features),
        "pace_by_dow": profile.pace_by_dow(features),
        "pace_by_dow_tod": profile.pace_by_dow_tod(features),
        "pace_trend_by_tod": profile.pace_by_dow_tod(features),
        "pace_timeseries": chartdata.timeseries(trimmed),
        "pace_histogram": chartdata.histogram(trimmed),
        "pace_density": chartdata.density(trimmed),
        "pace_histogram_shared": chartdata.histogram(trimmed, bins=20, shared_range=True),
        "pace_density_shared": chartdata.density(trimmed, shared_range=True),
    }
    assert set(report) == {*direct, "enumerator_days", "profile_base"}
    for name, table in direct.items():
        written, expected = spark_rows(comparable(report[name])), spark_rows(comparable(table))
        assert expected[1], name
        assert differences(written, expected) == [], name


def rows_of(report):
    return {name: spark_rows(comparable(table)) for name, table in report.items() if name != "input"}


def test_a_second_run_goes_on_where_the_first_ended(spark, tmp_path, monkeypatch):
    events = fixtures.events_uneven(spark, SF_DIR)
    folder = tmp_path / "report"
    expected = rows_of(write_report(events, str(folder)))
    written = {p: (folder / p / "_SUCCESS").stat().st_mtime_ns for p in ("enumerator_days", "summary_all")}
    # A run that broke off: one table is missing, another half written.
    (folder / "summary_all" / "_SUCCESS").unlink()
    for file in (folder / "pace_by_dow").iterdir():
        file.unlink()
    assert rows_of(write_report(events, str(folder))) == expected
    again = {p: (folder / p / "_SUCCESS").stat().st_mtime_ns for p in written}
    assert again["enumerator_days"] == written["enumerator_days"]
    assert again["summary_all"] != written["summary_all"]
    with pytest.raises(ValueError, match="other deliveries"):
        write_report(events.where("distance > 1"), str(folder))


def test_replaced_input_is_refused(spark, tmp_path):
    path = str(tmp_path / "in")
    events = fixtures.events_uneven(spark, SF_DIR)
    events.coalesce(1).write.parquet(path)
    folder = str(tmp_path / "report")
    first = rows_of(write_report(spark.read.parquet(path), folder))
    assert rows_of(write_report(spark.read.parquet(path), folder)) == first
    # Other rows under the same name of file.
    (name,) = (tmp_path / "in").glob("part-*")
    events.where("distance > 1").coalesce(1).write.parquet(str(tmp_path / "other"))
    (other,) = (tmp_path / "other").glob("part-*")
    name.write_bytes(other.read_bytes())
    (tmp_path / "in" / f".{name.name}.crc").unlink()
    with pytest.raises(ValueError, match="other deliveries"):
        write_report(spark.read.parquet(path), folder)


def test_days_are_written_by_campaign(spark, tmp_path):
    report = write_report(fixtures.events_uneven(spark, SF_DIR), str(tmp_path / "r"))
    one = report["enumerator_days"].where("city = 'Kenema'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(city" in plan


def test_deliveries_without_a_time_give_the_tables_they_can(spark, tmp_path):
    dated = fixtures.lineitem_pace(spark, SF_DIR)
    report = write_report(dated, str(tmp_path / "r"))
    assert not {"pace_by_tod", "pace_by_dow_tod", "pace_trend_by_tod"} & set(report)
    expected = spark_rows(comparable(stats.summary_all(pace.all_daily_pace(dated))))
    assert differences(spark_rows(comparable(report["summary_all"])), expected) == []
    timed = dated.withColumn("delivered_ts", F.col("date").cast("timestamp_ntz"))
    by_dow = profile.pace_by_dow(normalize.time_features(timed))
    assert differences(spark_rows(comparable(report["pace_by_dow"])), spark_rows(comparable(by_dow))) == []


def test_balancing_needs_adaptive_execution(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with pytest.raises(ValueError, match="adaptive"):
            land_by_campaign(fixtures.events_uneven(spark, SF_DIR), str(tmp_path / "x"), balance=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_the_cluster_settings_follow_the_input(spark):
    assert first_partitions(0) == 200
    assert first_partitions(100 << 40) == 200_000
    assert first_partitions(1 << 40) == 8192
    conf = cluster_conf(1 << 40)
    assert conf["spark.sql.shuffle.partitions"] == "8192"
    assert conf["spark.sql.adaptive.coalescePartitions.enabled"] == "true"
    changed = {k: v for k, v in conf.items() if spark.conf.isModifiable(k)}
    kept = {key: spark.conf.get(key, None) for key in changed}
    try:
        # The running session takes over what it can; a new one takes all of it.
        for key, value in changed.items():
            spark.conf.set(key, value)
        days = pace.count_enumerator_days(fixtures.events_uneven(spark, SF_DIR))
        assert "8192" in days._jdf.queryExecution().executedPlan().toString()
        # Small partitions are joined again at run time.
        assert days.rdd.getNumPartitions() < 100
    finally:
        for key, value in kept.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_a_cluster_session_is_built_with_the_settings_and_its_own(monkeypatch):
    given = {}

    class Builder:
        def appName(self, name):
            given["app"] = name
            return self

        def config(self, key, value):
            given[key] = value
            return self

        def getOrCreate(self):
            return given

    monkeypatch.setattr(session.SparkSession, "builder", Builder())
    built = session.cluster_session(1 << 40, app="pace", spark__executor__memory="8g")
    assert built == {"app": "pace", **cluster_conf(1 << 40), "spark.executor.memory": "8g"}


def test_scratch_follows_the_session(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    if before:
        assert path.startswith(before.rstrip("/") + "/x-")
    assert path != scratch_path(spark, "x")


def _random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        when = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(20 * 1440))
        # One enumerator, and one day, hold about a third of all rows each.
        who = "hot" if rng.random() < 0.34 else rng.choice("abcdef")
        if rng.random() < 0.33:
            when = when.replace(day=5)
        rows.append(
            (
                who if rng.random() > 0.03 else None,
                when if rng.random() > 0.05 else None,
                rng.choice([None, 10.0, 79.9, 80.0, 80.1, 400.0]),
            )
        )
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_invariants(spark, seed):
    rows = _random_rows(seed)
    frame = deliveries(spark, rows)

    counts = defaultdict(lambda: {"Unfiltered": 0, "Filtered": 0})
    for who, when, distance in rows:
        group = counts[(when.date() if when else None, who)]
        group["Unfiltered"] += 1
        group["Filtered"] += distance is not None and distance <= 80
    by_hand = {
        (dataset, date, who): n
        for (date, who), both in counts.items()
        for dataset, n in both.items()
        if n
    }
    result = {
        (r.dataset, r.date, r.enumerator): r.enum_daily_deliv
        for r in pace.enumerator_daily_counts(frame).collect()
    }
    assert result == by_hand

    per_day = defaultdict(list)
    for (dataset, date, _), n in by_hand.items():
        per_day[(dataset, date)].append(n)
    averages = {(r.dataset, r.date): r.daily_avg for r in pace.daily_pace(frame).collect()}
    assert averages == pytest.approx({key: statistics.fmean(v) for key, v in per_day.items()})

    kept = pace.all_daily_pace(frame)
    outside = kept.where("daily_avg < Q1 - 1.5 * IQR or daily_avg > Q3 + 1.5 * IQR")
    assert outside.count() == 0
    dropped = pace.daily_pace(frame).count() - kept.count()
    assert dropped > 0, "the hot day is an outlier, so the trim has something to drop"

    days = pace.count_enumerator_days(normalize.time_features(frame), by_shift=True)
    uneven = "deliveries <> aggregate(by_shift, 0L, (total, n) -> total + n)"
    assert days.where(uneven).count() == 0
    assert spark_rows(pace.average_days(days)) == spark_rows(pace.daily_pace(frame))

    bars = chartdata.histogram(kept).groupBy("dataset").agg(
        F.sum(F.col("density") * (F.col("bin_end") - F.col("bin_start"))).alias("area"),
        F.sum("count").alias("days"),
    )
    days = {r.dataset: r["count"] for r in kept.groupBy("dataset").count().collect()}
    for row in bars.collect():
        assert row.area == pytest.approx(1)
        assert row.days == days[row.dataset]
