"""CSV scans and the mapping of every layout onto one canonical table."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Mapping
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldtempo.functions import snake_case_names
from fieldtempo.operators.normalize import drop_missing_dates, split_multivalue
from fieldtempo.sources.listing import first_lines, list_files
from fieldtempo.sources.manifest import Layout, Source

# Field texts that mean "missing".
MISSING = ("", "NA")

#: The column that names the file a row comes from; a column of that name in a file is not read.
SOURCE = "source"


def _value(column: str) -> str:
    missing = ", ".join(f"'{text}'" for text in MISSING)
    return f"CASE WHEN trim({column}) NOT IN ({missing}) THEN trim({column}) END AS {column}"


def file_headers(spark: SparkSession, paths: Iterable[str]) -> dict[str, str]:
    """The header line of every file under the paths, read from the beginning of each file."""
    listed = list_files(spark, paths)
    return first_lines(spark, [file for files in listed.values() for file in files])


def _names(header: str) -> list[str]:
    cells = next(csv.reader([header.removeprefix("\ufeff")], skipinitialspace=True))
    return snake_case_names([cell.strip() for cell in cells])


def _scan(spark: SparkSession, files: list[str], header: str, multiline: bool) -> DataFrame:
    """Files of one header, every column as text, and ``source``."""
    names = _names(header)
    raw = spark.read.csv(
        [unquote(file) for file in sorted(files)],
        schema=StructType([StructField(name, StringType()) for name in names]),
        header=True,
        enforceSchema=True,
        escape='"',
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        multiLine=multiline,
        recursiveFileLookup=True,
    )
    values = [_value(f"`{name}`") for name in names if name != SOURCE]
    return raw.selectExpr(*values, f"_metadata.file_path AS {SOURCE}")


def _by_header(files: Iterable[str], headers: Mapping[str, str]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for file in files:
        if file in headers:
            found.setdefault(headers[file], []).append(file)
    return found


def read_csv(
    spark: SparkSession,
    path: str,
    multiline: bool = False,
    headers: Mapping[str, str] | None = None,
) -> DataFrame:
    """Every column as text, headers in snake_case, missing values as NULL, and ``source``, the file.

    Spark maps CSV columns by position, so the files of each distinct header are read with a schema
    of their own and stacked by name; a column a file lacks is NULL there. Repeated and empty headers
    get names of their own. Folders named like partitions are folders: only the files' columns count.
    ``headers``, from ``file_headers``, spares reading them where many paths are read.
    """
    files = list_files(spark, [path])[path]
    if headers is None:
        headers = first_lines(spark, files)
    grouped = _by_header([file.path for file in files], headers)
    if not grouped:
        raise ValueError(f"{path}: no file has a header")
    return reduce(_stacked, [_scan(spark, some, line, multiline) for line, some in grouped.items()])


def _stacked(above: DataFrame, below: DataFrame) -> DataFrame:
    return above.unionByName(below, allowMissingColumns=True)


def _required(
    spark: SparkSession,
    layout: Layout,
    multiline: bool,
    files: Iterable[str],
    headers: Mapping[str, str],
) -> DataFrame:
    """The layout's columns of all files, one scan for each header; NULL where a file lacks one."""
    frames = []
    for line, some in _by_header(files, headers).items():
        frame = _scan(spark, some, line, multiline)
        frames.append(frame.select(*[n for n in layout.required if n in frame.columns], SOURCE))
    return reduce(_stacked, frames).select(*layout.required, SOURCE)


def _check_columns(source: Source, lines: Iterable[str]) -> None:
    present = {name for line in set(lines) for name in _names(line)}
    if not present:
        raise ValueError(f"{source.city} {source.year}: no file has a header")
    absent = [name for name in source.layout.required if name not in present]
    if absent:
        raise ValueError(f"{source.city} {source.year}: no file has the columns {absent}")


def read_source(
    spark: SparkSession, source: Source, headers: Mapping[str, str] | None = None
) -> DataFrame:
    """The files of one campaign stacked by column name; a column a file lacks is NULL there."""
    listed = list_files(spark, source.paths)
    if headers is None:
        headers = first_lines(spark, [file for files in listed.values() for file in files])
    files = [file.path for path in source.paths for file in listed[path]]
    _check_columns(source, [headers[file] for file in files if file in headers])
    return _required(spark, source.layout, source.multiline, files, headers)


def canonical(raw: DataFrame, city: str, year: int, layout: Layout) -> DataFrame:
    """One row per delivery in the columns every campaign shares.

    Each text is parsed once, before the split, whatever filters follow. City and year are the campaign's labels: a row
    whose date falls in another year still counts under them.
    """
    return _canonical(raw, F.lit(city), F.lit(year).cast("int"), layout)


def _canonical(raw: DataFrame, city: Column, year: Column, layout: Layout) -> DataFrame:
    property_type = F.col(layout.property_type) if layout.property_type else F.lit(None)
    labelled = raw.select(
        city.alias("city"),
        year.alias("year"),
        F.col(SOURCE),
        F.col(layout.enumerator).alias("enumerator"),
        F.col(layout.delivered).alias("delivered_raw"),
        F.col(layout.distance).try_cast("double").alias("distance"),
        F.lit(layout.threshold).alias("threshold"),
        property_type.cast("string").alias("property_type"),
    )
    parsed = layout.parse(labelled, "delivered_raw", "delivered_ts")
    deliveries = parsed.withColumn("date", F.to_date("delivered_ts"))
    if layout.drop_missing_dates:
        deliveries = drop_missing_dates(deliveries)
    if layout.property_type:
        deliveries = split_multivalue(deliveries)
    return deliveries


#: Campaigns of a scan that are told apart by sets of files; more are joined by file.
MOST_SETS = 16
#: Files whose labels are broadcast; with more, every campaign has scans of its own.
MOST_LABELS = 200_000

Campaign = tuple[str, int]


def _labelled(
    spark: SparkSession, raw: DataFrame, campaigns: dict[Campaign, list[str]], layout: Layout
) -> DataFrame:
    """The canonical rows of a scan that holds several campaigns, by the file they come from."""
    names = list(campaigns)
    owned = [file for files in campaigns.values() for file in files]
    if len(names) == 1:
        return canonical(raw, *names[0], layout)
    if len(names) <= MOST_SETS and len(set(owned)) == len(owned):
        which = F.lit(None).cast("int")
        for n in reversed(range(len(names))):
            which = F.when(F.col(SOURCE).isin(campaigns[names[n]]), F.lit(n)).otherwise(which)
        raw = raw.withColumn("_campaign", which)
        cities, years = ([F.lit(name[part]) for name in names] for part in (0, 1))
        city, year = (F.array(*x)[F.col("_campaign")] for x in (cities, years))
        return _canonical(raw, city, year.cast("int"), layout)
    rows = [(file, city, year) for (city, year), files in campaigns.items() for file in files]
    labels = spark.createDataFrame(rows, "_file string, _city string, _year int")
    joined = raw.join(F.broadcast(labels), raw[SOURCE] == labels["_file"])
    return _canonical(joined, F.col("_city"), F.col("_year"), layout)


class NothingToReadError(ValueError):
    """No file is left, or all of them are blank."""


def read_campaigns(
    spark: SparkSession, sources: Iterable[Source], only: Iterable[str] | None = None
) -> DataFrame:
    """Every campaign in one canonical table.

    The files of all campaigns of a layout that have one header are one scan, and a layout's dates are
    parsed behind its scans, so a plan grows with layouts and headers, not with paths. To read some
    campaigns give their sources: a filter on city or year reads the files of the others as well.
    ``only`` are the files to read, as ``source`` names them; all if left out.
    """
    sources = list(sources)
    listed = list_files(spark, [path for source in sources for path in source.paths])
    headers = first_lines(spark, [file for files in listed.values() for file in files])
    wanted = None if only is None else set(only)
    scans: dict[tuple[Layout, bool], dict[Campaign, list[str]]] = {}
    for source in sources:
        files = [file.path for path in source.paths for file in listed[path]]
        _check_columns(source, [headers[file] for file in files if file in headers])
        campaigns = scans.setdefault((source.layout, source.multiline), {})
        campaigns.setdefault((source.city, source.year), []).extend(
            file for file in files if file in headers and (wanted is None or file in wanted)
        )
    frames = []
    for (layout, multiline), campaigns in scans.items():
        campaigns = {name: files for name, files in campaigns.items() if files}
        if sum(map(len, campaigns.values())) > MOST_LABELS:
            parts = [{name: files} for name, files in campaigns.items()]
        else:
            parts = [campaigns] if campaigns else []
        for part in parts:
            files = list(dict.fromkeys(file for some in part.values() for file in some))
            raw = _required(spark, layout, multiline, files, headers)
            frames.append(_labelled(spark, raw, part, layout))
    if not frames:
        raise NothingToReadError("no file to read")
    return reduce(DataFrame.unionByName, frames)
