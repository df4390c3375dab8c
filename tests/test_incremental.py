"""A report that grows with its files, and landing with one parse."""

import os

import pytest
from pyspark.sql import functions as F

from checks.queries import comparable
from fieldtempo.operators import normalize, pace
from fieldtempo.plans import incremental, update_report, write_report
from fieldtempo.sources import (
    DAY_FIRST_KM,
    ISO_METRES,
    Source,
    land_campaigns,
    landed_bad_dates,
    landed_date_states,
    read_campaigns,
    read_landed,
)
from tests.oracle_compare import differences, spark_rows

HEADER = "time_delivery_date,enteredby,time_gps_distance_original,property_type\n"


def day_file(folder, name, start, rows=60):
    """Days of uneven work; some dates missing, some unreadable."""
    lines = []
    for n in range(rows):
        time = f"{1 + (start + n * n) % 28:02}/03/2024 {(7 + n) % 24:02}:05:00"
        time = "NA" if n % 13 == 5 else f"rejected {n % 4}" if n % 17 == 3 else time
        types = '"A, B"' if n % 3 else "A"
        lines.append(f"{time},u{(start + n) % 7},{0.05 + n % 9 / 100},{types}")
    (folder / name).write_text(HEADER + "\n".join(lines) + "\n")


def iso_file(folder, name, start):
    lines = [f"2025-03-{1 + (start + n) % 28:02}T10:05:00Z,u{n % 5},{40 + n}" for n in range(50)]
    (folder / name).write_text("delivered_on,mobile_user_username,distance\n" + "\n".join(lines) + "\n")


def sources(folder):
    """Folders, so that new files in them belong to their campaign."""
    return [
        Source("Kenema", 2024, DAY_FIRST_KM, (f"{folder}/k",)),
        Source("Freetown", 2025, DAY_FIRST_KM, (f"{folder}/f",)),
        Source("Makeni", 2025, ISO_METRES, (f"{folder}/m",)),
    ]


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "files"
    for name in "kfm":
        (folder / name).mkdir(parents=True)
    day_file(folder / "k", "1.csv", 1)
    day_file(folder / "f", "1.csv", 5)
    iso_file(folder / "m", "1.csv", 3)
    return folder


@pytest.fixture
def read(monkeypatch):
    """The files that each run reads."""
    seen = []

    def watched(spark, sources, only=None):
        seen.append(sorted("/".join(path.rsplit("/", 2)[1:]) for path in only))
        return read_campaigns(spark, sources, only)

    monkeypatch.setattr(incremental, "read_campaigns", watched)
    return seen


@pytest.fixture
def days_only(monkeypatch):
    """Leaves out the tables, which follow from the counts."""
    monkeypatch.setattr(incremental, "write_tables", lambda days, folder: {})


def rows(report):
    return {name: spark_rows(comparable(table)) for name, table in report.items()}


def same_days(spark, report, files):
    features = normalize.time_features(read_campaigns(spark, sources(files)))
    direct = pace.count_enumerator_days(features, by_shift=True).select(report["enumerator_days"].columns)
    assert spark_rows(report["enumerator_days"]) == spark_rows(direct)


def same_as_full(spark, report, files, tmp_path, name):
    full = rows(write_report(read_campaigns(spark, sources(files)), str(tmp_path / name)))
    found = rows(report)
    assert set(found) == set(full)
    for table, expected in full.items():
        assert expected[1], table
        assert differences(found[table], expected) == [], table


def test_new_files_alone_are_read(spark, tmp_path, files, read):
    folder = str(tmp_path / "report")
    first = update_report(spark, sources(files), folder)
    assert read == [["f/1.csv", "k/1.csv", "m/1.csv"]]
    same_days(spark, first, files)
    # Days of which there are counts already, and new ones.
    day_file(files / "k", "2.csv", 2)
    second = update_report(spark, sources(files), folder)
    assert read[1:] == [["k/2.csv"]]
    same_as_full(spark, second, files, tmp_path, "full 2")
    update_report(spark, sources(files), folder)
    assert len(read) == 2


def test_a_changed_or_absent_file_takes_its_batch_along(spark, tmp_path, files, read, days_only):
    folder = str(tmp_path / "report")
    update_report(spark, sources(files), folder)
    day_file(files / "k", "2.csv", 2)
    update_report(spark, sources(files), folder)
    day_file(files / "f", "1.csv", 11, rows=90)
    report = update_report(spark, sources(files), folder)
    assert read[2:] == [["f/1.csv", "k/1.csv", "m/1.csv"]]
    same_days(spark, report, files)
    (files / "k" / "1.csv").rename(files / "k" / "1.csv._COPYING_")
    report = update_report(spark, sources(files), folder)
    assert read[3:] == [["f/1.csv", "m/1.csv"]]
    same_days(spark, report, files)


def test_blank_files_add_nothing(spark, tmp_path, files, read, days_only):
    folder = str(tmp_path / "report")
    update_report(spark, sources(files), folder)
    (files / "k" / "blank.csv").write_text("\n")
    same_days(spark, update_report(spark, sources(files), folder), files)
    assert read[1:] == [["k/blank.csv"]] and len(incremental.known_batches(spark, folder)) == 1


def test_many_batches_become_one_without_reading_files(spark, tmp_path, files, read, days_only, monkeypatch):
    monkeypatch.setattr(incremental, "MOST_BATCHES", 2)
    folder = str(tmp_path / "report")
    for n in (0, 2, 3):
        if n:
            day_file(files / "k", f"{n}.csv", n)
        report = update_report(spark, sources(files), folder)
    assert read == [["f/1.csv", "k/1.csv", "m/1.csv"], ["k/2.csv"], ["k/3.csv"]]
    present = incremental.present_files(spark, sources(files))
    known = incremental.known_batches(spark, folder)
    assert len(known) == 4 and len(incremental.usable_batches(known, present)) == 1
    same_days(spark, report, files)


def test_a_run_that_broke_off_goes_on(spark, tmp_path, files, read, monkeypatch):
    folder = str(tmp_path / "report")
    with monkeypatch.context() as broken:
        broken.setattr(incremental, "write_tables", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            update_report(spark, sources(files), folder)
    report = update_report(spark, sources(files), folder)
    assert len(read) == 1
    same_days(spark, report, files)


def test_batches_that_share_a_file_are_not_added_up():
    a, b, c = (("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 1, "x"))
    batches = {"1": frozenset([a, b]), "2": frozenset([b, c]), "3": frozenset([c])}
    assert incremental.usable_batches(batches, [a, b, c]) == ["1", "3"]
    assert incremental.usable_batches(batches, [b, c]) == ["2"]
    changed = ("a", 1, 2, "x")
    assert incremental.usable_batches(batches, [changed, b]) == []


def test_the_sum_has_as_many_partitions_as_the_written_batches_need(spark):
    """Nearly all rows are groups of their own."""
    days = spark.range(300_000).selectExpr(
        "'Kenema' AS city", "2024 AS year", "date_add(date'2024-01-01', cast(id % 300 as int)) AS date",
        "concat('u', id div 2) AS enumerator", "2L AS deliveries", "1L AS accurate",
        "array(1L, 1L, 0L, 0L) AS by_shift",
    )
    assert incremental.merge_partitions(0) == 0
    written = 24 * incremental.SHUFFLE_BYTES // incremental.UNPACKED
    assert incremental.merge_partitions(written) == 24
    added = incremental.merged([days, days], written)
    tasks = sorted(r["count"] for r in added.groupBy(F.spark_partition_id()).count().collect())
    assert len(tasks) == 24 and tasks[-1] < 2 * tasks[12]
    assert added.agg(F.sum("deliveries")).first()[0] == 1_200_000


def test_landing_tells_bad_dates_without_another_parse(spark, tmp_path, files):
    folder = str(tmp_path / "landed")
    landed = land_campaigns(spark, sources(files), folder)
    deliveries = read_campaigns(spark, sources(files))
    expected = deliveries.where("delivered_raw is not null and delivered_ts is null")
    assert landed.rows == deliveries.count() == read_landed(spark, folder).count()
    assert landed.bad_dates == expected.count() > 0
    assert landed.missing_dates == deliveries.where("delivered_raw is null").count()
    bad = landed_bad_dates(spark, folder)
    texts = expected.select("city", "year", "delivered_raw").distinct()
    assert spark_rows(bad) == spark_rows(texts)
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp" not in plan
    physical = bad._jdf.queryExecution().executedPlan().toString()
    assert "date_text#" in physical.split("PartitionFilters: ")[1].split("]")[0]
    states = {tuple(r)[:3]: r["deliveries"] for r in landed_date_states(spark, folder).collect()}
    assert sum(states.values()) == landed.rows
    assert sum(n for (_, _, state), n in states.items() if state == "bad") == landed.bad_dates
    report = write_report(read_landed(spark, folder), str(tmp_path / "report"))
    same_as_full(spark, report, files, tmp_path, "full")
    assert normalize.accuracy_filter(read_landed(spark, folder)).count() > 0
    assert os.path.isdir(f"{folder}/city=Kenema/year=2024/date_text=bad")
