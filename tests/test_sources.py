"""CSV layouts, multi-file campaigns, the canonical table and landing."""

import datetime
import gzip
import re
import time

import pytest

from fieldtempo.operators import normalize, pace, stats
from fieldtempo.sources import csv_files, listing
from fieldtempo.sources import (
    DAY_FIRST_KM,
    ISO_METRES,
    MIXED_KM,
    MONTH_FIRST_METRES,
    Source,
    campaign_sources,
    land_by_campaign,
    read_campaigns,
    read_csv,
    read_landed,
    read_source,
)


def values(frame):
    """The rows without the file they come from."""
    return [tuple(row) for row in frame.drop("source").collect()]


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_text(text, encoding=encoding)
    return str(path)


def test_missing_values_blanks_and_quotes(spark, tmp_path):
    path = write(
        tmp_path,
        "a.csv",
        "Time Delivery Date,Property Type,Remark\n"
        ' 14/03/2024 09:05:00 ,"Domestic, ""Shop"", Kiosk", NA \n'
        'NA,"",""" x """\n'
        ",NA,N/A\n"
        "\n",
    )
    frame = read_csv(spark, path)
    assert frame.columns == ["time_delivery_date", "property_type", "remark", "source"]
    assert values(frame) == [
        ("14/03/2024 09:05:00", 'Domestic, "Shop", Kiosk', None),
        (None, None, '" x "'),
        (None, None, "N/A"),
    ]


def test_byte_order_mark_and_short_rows(spark, tmp_path):
    path = write(tmp_path, "a.csv", "User Name,Distance,Delivered On\nu1,5\n", "utf-8-sig")
    frame = read_csv(spark, path)
    assert frame.columns == ["user_name", "distance", "delivered_on", "source"]
    assert values(frame) == [("u1", "5", None)]


def test_repeated_and_empty_headers(spark, tmp_path):
    path = write(tmp_path, "a.csv", '\n,Distance,"distance",User Name\n1,2,3,u1\n')
    frame = read_csv(spark, path)
    assert frame.columns == ["x", "distance", "distance_2", "user_name", "source"]
    assert values(frame) == [("1", "2", "3", "u1")]


def test_quoted_headers(spark, tmp_path):
    path = write(tmp_path, "a.csv", '"Distance, metres" , "The ""user"""\n5,u1\n')
    frame = read_csv(spark, path)
    assert frame.columns == ["distance_metres", "the_user", "source"]
    assert values(frame) == [("5", "u1")]


def test_an_empty_file_has_no_columns(spark, tmp_path):
    empty = write(tmp_path, "a.csv", "")
    with pytest.raises(ValueError, match="no file has a header"):
        read_csv(spark, empty)
    write(tmp_path, "b.csv", "a\n1\n")
    assert values(read_csv(spark, str(tmp_path))) == [("1",)]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a,b\n"x\ny",1\nz,2\n')
    assert values(read_csv(spark, path, multiline=True)) == [
        ("x\ny", "1"),
        ("z", "2"),
    ]


def test_files_of_one_path_may_differ_in_their_headers(spark, tmp_path):
    write(tmp_path, "1.csv", "a,b\n1,2\n")
    write(tmp_path, "2.csv", "b,a\n2,1\n3,4\n")
    write(tmp_path, "3.csv", "A,,c\n5,6,7\n")
    rows = read_csv(spark, str(tmp_path)).collect()
    assert sorted((r.a, r.b, r.c, r.x, r.source.rsplit("/", 1)[1]) for r in rows) == [
        ("1", "2", None, None, "1.csv"),
        ("1", "2", None, None, "2.csv"),
        ("4", "3", None, None, "2.csv"),
        ("5", None, "7", "6", "3.csv"),
    ]


def test_repeated_headers_in_another_order_are_not_swapped(spark, tmp_path):
    write(tmp_path, "1.csv", "When,Who,Note,note\n2025-03-04,u1,x,y\n")
    write(tmp_path, "2.csv", "Who,When,Note,note\nu2,2025-03-05,x,y\n")
    rows = read_csv(spark, str(tmp_path)).collect()
    assert {(r.who, r.when, r.note, r.note_2) for r in rows} == {
        ("u1", "2025-03-04", "x", "y"),
        ("u2", "2025-03-05", "x", "y"),
    }


def test_folders_named_like_partitions(spark, tmp_path):
    for day, order in ((1, "a,b\n1,2\n"), (2, "b,a\n2,1\n")):
        folder = tmp_path / f"dt={day} x" / "team=1"
        folder.mkdir(parents=True)
        write(folder, "a b.csv", order)
    for path in (str(tmp_path), f"{tmp_path}/*", f"{tmp_path}/*/*"):
        frame = read_csv(spark, path)
        assert frame.columns == ["a", "b", "source"]
        assert values(frame) == [("1", "2")] * 2


def test_the_rows_number_does_not_decide_on_the_header(spark, tmp_path):
    lines = "".join(f"{n},{n}\n" for n in range(50_000))
    write(tmp_path, "1.csv", "key,other\n" + lines)
    write(tmp_path, "2.csv", "other,key\n" + lines)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        frame = read_csv(spark, str(tmp_path))
        assert frame.count() == 100_000
        assert frame.where("key <> other").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_files_stack_by_name(spark, tmp_path):
    first = write(
        tmp_path,
        "team_1.csv",
        "time_delivery_date,enteredby,time_gps_distance_original,property_type,extra\n"
        '14/03/2024 09:05:00,u3,0.08,"Domestic, Commercial",x\n',
    )
    second = write(
        tmp_path,
        "team_2.csv",
        "Enteredby,Time GPS Distance Original,Time Delivery Date\nu4,0.081,03/14/2024 09:05\n",
    )
    rows = read_source(spark, Source("Freetown", 2024, MIXED_KM, (first, second)))
    assert {(r.time_delivery_date, r.enteredby, r.property_type) for r in rows.collect()} == {
        ("14/03/2024 09:05:00", "u3", "Domestic, Commercial"),
        ("03/14/2024 09:05", "u4", None),
    }
    deliveries = read_campaigns(spark, [Source("Freetown", 2024, MIXED_KM, (first, second))])
    assert sorted(map(str, (r.property_type for r in deliveries.collect()))) == [
        "Commercial",
        "Domestic",
        "None",
    ]
    assert normalize.accuracy_filter(deliveries).count() == 2
    assert {r.date for r in deliveries.collect()} == {datetime.date(2024, 3, 14)}
    files = {r.source.removeprefix("file:") for r in deliveries.collect()}
    assert files == {first, second}


def test_a_column_no_file_has_is_an_error(spark, tmp_path):
    path = write(tmp_path, "a.csv", "delivered_on,distance\n2025-03-04,5\n")
    with pytest.raises(ValueError, match="mobile_user_username"):
        read_source(spark, Source("Makeni", 2025, ISO_METRES, (path,)))


def test_layouts(spark, tmp_path):
    iso = write(
        tmp_path,
        "iso.csv",
        "Delivered On,Mobile User Username,Distance\n"
        "2025-03-04T10:05:00Z,u1,41.5\n,u1,80\nnot a date,u1,80.5\n2024-12-31 23:59:59,u1,far\n",
    )
    month_first = write(
        tmp_path,
        "month.csv",
        "delivered_on,user_name,distance\n3/14/2025 9:05,u2,80\nNA,u2,\n",
    )
    day_first = write(
        tmp_path,
        "day.csv",
        "time_delivery_date,enteredby,time_gps_distance_original,property_type\n"
        '14/03/2024 09:05:00,u3,0.08,"Domestic, Commercial,"\n'
        "03/14/2024 09:05:00,u3,0.01,NA\n"
        "NA,u3,0.01,Domestic\n",
    )
    deliveries = read_campaigns(
        spark,
        [
            Source("Makeni", 2025, ISO_METRES, (iso,)),
            Source("Kenema", 2025, MONTH_FIRST_METRES, (month_first,)),
            Source("Kenema", 2024, DAY_FIRST_KM, (day_first,)),
        ],
    )
    rows = [
        (r.city, r.year, str(r.date), r.distance, r.property_type) for r in deliveries.collect()
    ]
    assert sorted(rows, key=str) == sorted(
        [
            ("Makeni", 2025, "2025-03-04", 41.5, None),
            ("Makeni", 2025, "None", 80.0, None),  # missing dates stay in this layout
            ("Makeni", 2025, "None", 80.5, None),
            ("Makeni", 2025, "2024-12-31", None, None),  # the label, not the date, gives the year
            ("Kenema", 2025, "2025-03-14", 80.0, None),
            ("Kenema", 2025, "None", None, None),
            ("Kenema", 2024, "2024-03-14", 0.08, "Domestic"),
            ("Kenema", 2024, "2024-03-14", 0.08, "Commercial"),
            ("Kenema", 2024, "2024-03-14", 0.08, ""),
            ("Kenema", 2024, "None", 0.01, None),  # unreadable text stays, missing text goes
        ],
        key=str,
    )
    assert normalize.accuracy_filter(deliveries).count() == 7


def test_known_campaigns():
    sources = campaign_sources("/data/")
    assert len(sources) == 8
    assert sum(len(source.paths) for source in sources) == 13
    assert len({(source.city, source.year) for source in sources}) == 8
    assert all(path.startswith("/data/") for source in sources for path in source.paths)
    split = {(s.city, s.year) for s in sources if s.layout.property_type}
    assert split == {("Kenema", 2024)} | {("Freetown", year) for year in range(2021, 2026)}
    assert {s.layout.threshold for s in sources if s.layout.property_type} == {0.08}
    assert {s.layout.threshold for s in sources if not s.layout.property_type} == {80.0}


def test_landing_keeps_the_result_and_prunes(spark, tmp_path):
    path = write(
        tmp_path,
        "day.csv",
        "time_delivery_date,enteredby,time_gps_distance_original,property_type\n"
        '14/03/2024 09:05:00,u3,0.08,"Domestic, Commercial"\n'
        "15/03/2024 09:05:00,u3,0.09,Domestic\n",
    )
    sources = [
        Source("Kenema", 2024, DAY_FIRST_KM, (path,)),
        Source("Freetown", 2025, DAY_FIRST_KM, (path,)),
    ]
    deliveries = read_campaigns(spark, sources)
    folder = str(tmp_path / "landed")
    land_by_campaign(deliveries, folder)
    landed = read_landed(spark, folder)

    def summary(frame):
        return [tuple(row) for row in stats.summary_all(pace.all_daily_pace(frame)).collect()]

    assert summary(landed) == summary(deliveries)
    one = landed.where("city = 'Kenema'")
    assert one.count() == 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*city#\d+ = Kenema", plan)
    with pytest.raises(Exception, match="(?i)exist"):
        land_by_campaign(deliveries, folder)


def test_known_campaigns_end_to_end(spark, tmp_path):
    sources = campaign_sources(str(tmp_path))
    texts = {
        ISO_METRES: [f"2025-03-0{d}T10:05:00Z" for d in range(1, 6)],
        MONTH_FIRST_METRES: [f"3/{d}/2025 9:05" for d in range(1, 6)],
        DAY_FIRST_KM: [f"0{d}/03/2024 09:05:00" for d in range(1, 6)],
        MIXED_KM: [f"2{d}/03/2024 09:05" for d in range(1, 6)],
    }
    for source in sources:
        layout = source.layout
        for file in source.paths:
            lines = [",".join(layout.required)]
            for number, text in enumerate(texts[layout]):
                near, far = layout.threshold, layout.threshold * 1.01
                types = ['"A, B"'] if layout.property_type else []
                # Two accurate deliveries a day and, on the last day, one that is not.
                distances = [near, near] + ([far] if number == 4 else [])
                lines += [",".join([text, "u1", str(d), *types]) for d in distances]
            write(tmp_path, file.rsplit("/", 1)[1], "\n".join(lines) + "\n")
    days = pace.daily_pace(read_campaigns(spark, sources)).collect()
    assert len(days) == 8 * 2 * 5
    for row in days:
        files = next(len(s.paths) for s in sources if (s.city, s.year) == (row.city, row.year))
        split = 1 if row.year == 2025 and row.city != "Freetown" else 2
        last = row.dataset == "Unfiltered" and row.date.day % 10 == 5
        assert row.daily_avg == files * split * (3 if last else 2)


def bytes_read(spark):
    """Bytes that this JVM has read from local files."""
    statistics = spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file")
    return statistics.getLong("bytesRead")


def test_headers_are_read_without_the_rows_behind_them(spark, tmp_path):
    sizes = []
    for rows in (20_000, 400_000):
        folder = tmp_path / str(rows)
        folder.mkdir()
        for name in "ab":
            write(folder, f"{name}.csv", "key,other\n" + "12345,67890\n" * rows)
        before = bytes_read(spark)
        headers = csv_files.file_headers(spark, [str(folder)])
        sizes.append(bytes_read(spark) - before)
        assert set(headers.values()) == {"key,other"} and len(headers) == 2
        assert csv_files.read_csv(spark, str(folder)).count() == 2 * rows
    assert sizes[0] == sizes[1] < 600_000


def test_a_header_must_begin_its_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "HEADER_BYTES", 64)
    path = write(tmp_path, "a.csv", "\n" * 100 + "a,b\n1,2\n")
    with pytest.raises(ValueError, match="no header in its first 64 bytes"):
        read_csv(spark, path)
    path = write(tmp_path, "b.csv", ",".join(f"column_{n}" for n in range(20)) + "\n")
    with pytest.raises(ValueError, match="no header"):
        read_csv(spark, path)


def test_compressed_files_and_hidden_ones(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as file:
        file.write("a,b\n1,2\n")
    write(tmp_path, "_SUCCESS", "")
    write(tmp_path, ".hidden.csv", "x,y\n3,4\n")
    assert values(read_csv(spark, str(tmp_path))) == [("1", "2")]
    with pytest.raises(ValueError, match="no such file"):
        read_csv(spark, str(tmp_path / "absent"))


def many_campaigns(tmp_path, campaigns, files):
    sources = []
    for c in range(campaigns):
        paths = []
        for n in range(files):
            order = ["enteredby", "time_delivery_date", "time_gps_distance_original", "property_type"]
            row = {"enteredby": f"u{c}", "time_delivery_date": f"1{n}/03/2024 09:05:00"}
            row |= {"time_gps_distance_original": "0.01", "property_type": "Domestic"}
            order = order[n % 2 :] + order[: n % 2]
            lines = [",".join(order), ",".join(row[name] for name in order)]
            paths.append(write(tmp_path, f"{c}_{n}.csv", "\n".join(lines) + "\n"))
        sources.append(Source(f"city {c}", 2024, MIXED_KM if c % 2 else DAY_FIRST_KM, tuple(paths)))
    return sources


@pytest.mark.parametrize("sets, labels", [(16, 100), (2, 100), (2, 3)])
def test_campaigns_are_told_apart_by_sets_joins_or_scans(spark, tmp_path, monkeypatch, sets, labels):
    monkeypatch.setattr(csv_files, "MOST_SETS", sets)
    monkeypatch.setattr(csv_files, "MOST_LABELS", labels)
    sources = many_campaigns(tmp_path, 6, 3)
    deliveries = read_campaigns(spark, sources)
    plan = deliveries._jdf.queryExecution().executedPlan().toString()
    found = sorted((r.city, r.year, r.enumerator, r.date.day) for r in deliveries.collect())
    assert found == [(f"city {c}", 2024, f"u{c}", 10 + n) for c in range(6) for n in range(3)]
    # Two layouts of two headers each; or the two headers of every campaign.
    assert plan.count("FileScan csv") == (12 if labels == 3 else 4)
    assert ("BroadcastHashJoin" in plan) == (sets == 2 and labels == 100)


def test_a_plan_of_many_paths_is_as_small_as_one_of_few(spark, tmp_path):
    plans = []
    for campaigns in (4, 100):
        folder = tmp_path / str(campaigns)
        folder.mkdir()
        sources = many_campaigns(folder, campaigns, 2)
        start = time.perf_counter()
        deliveries = read_campaigns(spark, sources)
        took = time.perf_counter() - start
        plans.append(deliveries._jdf.queryExecution().optimizedPlan().toString())
        assert deliveries.select("city").distinct().count() == campaigns
    assert took < 20
    assert plans[0].count("Relation") == 4 and plans[1].count("Relation") == 4


def test_only_some_files_are_read(spark, tmp_path):
    sources = many_campaigns(tmp_path, 3, 2)
    some = [file.path for file in listing.list_files(spark, [sources[1].paths[0]])[sources[1].paths[0]]]
    rows = read_campaigns(spark, sources, only=some).collect()
    assert [(r.city, r.source) for r in rows] == [("city 1", some[0])]
