"""Physical plans: scans, shuffles, pushdown, no Python workers."""

import re

import pytest
from pyspark.sql import functions as F

from checks import fixtures
from checks.queries import queries
from fieldtempo import functions
from fieldtempo.operators import chartdata, normalize, pace, stats
from fieldtempo.plans import report
from fieldtempo.sources import ISO_METRES, read_campaigns, read_source

SF_DIR = "/root/testdata/sf0.001"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange (\w+)(?:\(([^)]*)\))?", plan)


def trimmed(spark):
    return pace.all_daily_pace(fixtures.lineitem_pace(spark, SF_DIR))


def test_both_datasets_come_from_one_scan_and_three_shuffles(spark):
    plan = plan_of(stats.pace_stats(trimmed(spark)))
    assert plan.count("FileScan") == 1
    assert len(exchanges(plan)) == 3
    assert "SinglePartition" not in plan
    assert "Join" not in plan


def test_counts_are_combined_before_the_first_shuffle(spark):
    plan = plan_of(pace.daily_pace(fixtures.lineitem_pace(spark, SF_DIR)))
    below_first_shuffle = plan[plan.rindex("Exchange") :]
    assert "partial_count" in below_first_shuffle
    assert "Expand" not in below_first_shuffle


def test_only_the_needed_columns_are_read(spark):
    plan = plan_of(pace.daily_pace(fixtures.lineitem_pace(spark, SF_DIR)))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {field.split(":")[0] for field in schema.split(",")} == {
        "l_suppkey",
        "l_quantity",
        "l_shipdate",
    }


def test_accuracy_filter_reaches_the_scan(spark):
    accurate = normalize.accuracy_filter(fixtures.events_pace(spark, SF_DIR))
    plan = plan_of(pace.daily_pace(accurate))
    assert "LessThanOrEqual(value,80.0)" in plan


def test_histograms_need_no_shuffle_of_their_own(spark):
    assert len(exchanges(plan_of(chartdata.histogram(trimmed(spark))))) == 3


def test_curves_are_dealt_to_several_tasks(spark):
    curve = chartdata.density(trimmed(spark))
    found = exchanges(plan_of(curve))
    assert len(found) == 4
    assert found[0][1].endswith(f"{chartdata.CURVE_TASKS}")
    points = curve.groupBy(F.spark_partition_id()).count().count()
    assert points > 4


def test_curve_tasks_follow_the_days_and_points():
    assert chartdata.curve_tasks(0) == chartdata.curve_tasks(10_000) == chartdata.CURVE_TASKS
    days = 20_000 * 365 * 4
    tasks = chartdata.curve_tasks(days)
    assert tasks * chartdata.TASK_KERNELS >= days * chartdata.CURVE_POINTS > (tasks - 1) * chartdata.TASK_KERNELS


def test_curves_of_many_campaigns_are_spread_evenly(spark):
    days = spark.range(400).selectExpr(
        "concat('c', id) AS city", "2024 AS year", "'Unfiltered' AS dataset",
        "explode(sequence(date'2024-01-01', date'2024-01-12')) AS date",
    ).withColumn("daily_avg", F.dayofmonth("date") * 1.5)
    curve = chartdata.density(days, points=16, tasks=40)
    tasks = [r["count"] for r in curve.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 40 and max(tasks) < 2 * sorted(tasks)[20]


def test_a_curve_refuses_more_rows_than_days(spark, monkeypatch):
    monkeypatch.setattr(chartdata, "MOST_DAYS", 3)
    with pytest.raises(Exception, match="one row per key and day"):
        chartdata.density(trimmed(spark)).collect()


def test_shared_axis_scans_once(spark):
    table = chartdata.histogram(trimmed(spark), bins=20, shared_range=True)
    table.collect()
    final = plan_of(table).split("== Initial Plan ==")[0]
    main = final[: final.index("Subquery")] + final[final.rindex("Subquery") :]
    assert "ReusedExchange" in plan_of(table)
    assert "CartesianProduct" not in main and "NestedLoop" not in main


PREDICATES = [
    "ts IS NOT NULL",
    "to_date(ts) IS NOT NULL",
    "ts BETWEEN timestamp_ntz'2024-01-05' AND timestamp_ntz'2024-01-20'",
    "year(ts) = 2024",
]


@pytest.mark.parametrize("predicate", [None, *PREDICATES])
@pytest.mark.parametrize(
    "text, parse, pattern",
    [
        ("iso_text", functions.parse_iso, "RLIKE"),
        ("mdy_text", functions.parse_mdy_hm, "regexp_extract_all"),
        ("mixed_text", functions.parse_dmy_hms, "regexp_extract_all"),
        ("mixed_text", functions.parse_mixed, "regexp_extract_all"),
    ],
)
def test_a_predicate_on_the_result_does_not_repeat_the_parse(spark, text, parse, pattern, predicate):
    parsed = parse(fixtures.events_text(spark, SF_DIR).select("event_id", text), text, "ts")
    if predicate:
        parsed = parsed.where(predicate)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(pattern) == 1


@pytest.mark.parametrize("predicate", [None, *PREDICATES])
def test_a_predicate_on_campaigns_does_not_repeat_the_parse(spark, predicate):
    sources = fixtures.manifest_csv(spark, SF_DIR)
    deliveries = read_campaigns(spark, sources).withColumn("ts", F.col("delivered_ts"))
    if predicate:
        deliveries = deliveries.where(predicate)
    plan = deliveries._jdf.queryExecution().optimizedPlan().toString()
    # One for each layout whose dates are not ISO, behind the scans of all its files.
    layouts = {source.layout for source in sources if source.layout is not ISO_METRES}
    assert plan.count("regexp_extract_all") == len(layouts) == 3


def test_scans_are_as_many_as_layouts_and_headers(spark):
    sources = fixtures.manifest_csv(spark, SF_DIR)
    plan = plan_of(read_campaigns(spark, sources))
    assert plan.count("FileScan csv") == len({source.layout for source in sources}) == 4
    assert "Join" not in plan


@pytest.mark.parametrize("parse", [functions.parse_iso, functions.parse_mdy_hm, functions.parse_mixed])
def test_the_parse_is_one_stage_of_code_that_the_jvm_compiles(spark, parse, capsys):
    """The JVM interprets methods of more than 8000 bytes of code, which is several times slower."""
    text = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    parse(text, "text", "ts").explain("codegen")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)
    assert len(sizes) == 1 and int(sizes[0]) < 8000


def test_only_the_needed_csv_columns_are_read(spark):
    source = fixtures.manifest_csv(spark, SF_DIR)[-1]
    plan = plan_of(read_source(spark, source).groupBy("enteredby").count())
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"enteredby:string"}


def test_enumerator_days_are_read_twice_by_the_report(spark, tmp_path, monkeypatch):
    read = []
    spark_plan = report._written

    def watched(table, path, write):
        read.append((path, any("/enumerator_days/" in file for file in table.inputFiles())))
        return spark_plan(table, path, write)

    monkeypatch.setattr(report, "_written", watched)
    report.write_report(fixtures.events_uneven(spark, SF_DIR), str(tmp_path / "r"))
    assert len(read) == 16
    assert sum(found for _, found in read) == 2


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_workers_and_no_joins(spark, name):
    plan = plan_of(queries()[name](spark, SF_DIR))
    assert "EvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan
    assert "Join" not in plan and "Cartesian" not in plan
