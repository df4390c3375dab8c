"""A report over campaign files that grow in number: new files alone are read.

Counts per enumerator and day can be added up. They are kept by batch, a batch being the files that one
run has read, with the files' names, lengths and times of change. A run uses the batches whose files are
all as they were, reads what no such batch holds as a new batch, and adds the batches up: one shuffle of
counts, combined on the map side, in place of a pass over all deliveries. A file that has changed or
gone takes its batch with it, whose other files are read again. Many batches are added up to one.

A batch is named after its files and marked as finished by the list of them, which is written last; the
tables are named after the batches they are of. So a run that was cut off goes on where it ended, and
one without news reads finished tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtempo.functions import SHIFT_LABELS
from fieldtempo.operators import pace
from fieldtempo.operators.normalize import time_features
from fieldtempo.plans.report import ENUMERATOR_DAYS, write_tables
from fieldtempo.session import SHUFFLE_BYTES
from fieldtempo.sources.csv_files import NothingToReadError, read_campaigns
from fieldtempo.sources.landing import CAMPAIGN_FOLDERS
from fieldtempo.sources.listing import list_files
from fieldtempo.sources.manifest import Source

BATCHES = "batches"
TABLES = "tables"
COUNTS = "counts"
FILES = "files"
#: Batches that a run adds up each time; more become one.
MOST_BATCHES = 32
#: Bytes in a shuffle for each byte of Parquet, about.
UNPACKED = 4

DAYS_SCHEMA = (
    "date date, enumerator string, deliveries bigint, accurate bigint, by_shift array<bigint>, "
    "city string, year int"
)
FILES_SCHEMA = "batch string, path string, length bigint, modified bigint, read_as string"

#: Path, length, time of change, and the campaign and layout it is read as.
FileState = tuple[str, int, int, str]


def present_files(spark: SparkSession, sources: Iterable[Source]) -> list[FileState]:
    sources = list(sources)
    listed = list_files(spark, [path for source in sources for path in source.paths])
    found = set()
    for source in sources:
        layout = source.layout
        columns = (layout.required, layout.threshold, layout.parse.__name__, layout.drop_missing_dates)
        read_as = repr((source.city, source.year, source.multiline, *columns))
        for path in source.paths:
            found |= {(f.path, f.length, f.modified, read_as) for f in listed[path]}
    return sorted(found)


def _named(files: Iterable[object]) -> str:
    return hashlib.sha256("\n".join(map(repr, sorted(files))).encode()).hexdigest()[:32]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def known_batches(spark: SparkSession, folder: str) -> dict[str, frozenset[FileState]]:
    """The files of every finished batch."""
    if not _exists(spark, f"{folder}/{FILES}"):
        return {}
    found: dict[str, set[FileState]] = {}
    listed = spark.read.schema(FILES_SCHEMA).parquet(f"{folder}/{FILES}")
    # As long as the list of files, which the driver has anyway.
    for row in listed.collect():
        found.setdefault(row["batch"], set()).add(tuple(row)[1:])
    return {batch: frozenset(files) for batch, files in found.items()}


def usable_batches(
    batches: dict[str, frozenset[FileState]], present: Iterable[FileState]
) -> list[str]:
    """Batches without a file in common, all of whose files are present as they were; large ones first."""
    left = set(present)
    chosen = []
    for batch, files in sorted(batches.items(), key=lambda item: (-len(item[1]), item[0])):
        if files <= left:
            chosen.append(batch)
            left -= files
    return chosen


def merge_partitions(written: int) -> int:
    """Partitions in which so many bytes of batches, as Parquet, are added up."""
    return -(-written * UNPACKED // SHUFFLE_BYTES)


def merged(counts: list[DataFrame], written: int = 0) -> DataFrame:
    """Counts per enumerator and day, added up.

    How much there is to shuffle is known here, from the bytes that have been ``written``: with more
    than the session's partitions are made for, there are as many as they need. Rows of one batch have
    been combined, so a group has no more of them than there are batches.
    """
    by_shift = [F.sum(F.col("by_shift")[n]) for n in range(len(SHIFT_LABELS))]
    keys = (*CAMPAIGN_FOLDERS, "date", "enumerator")
    rows = reduce(DataFrame.unionByName, counts)
    needed = merge_partitions(written)
    if needed > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(needed, *keys)
    return (
        rows.groupBy(*keys)
        .agg(
            F.sum("deliveries").alias("deliveries"),
            F.sum("accurate").alias("accurate"),
            F.array(*by_shift).alias("by_shift"),
        )
    )


def _added_up(spark: SparkSession, folder: str, batches: Iterable[str]) -> DataFrame:
    paths = [f"{folder}/{BATCHES}/{batch}/{COUNTS}" for batch in batches]
    written = sum(file.length for files in list_files(spark, paths).values() for file in files)
    return merged([spark.read.schema(DAYS_SCHEMA).parquet(path) for path in paths], written)


def _write_batch(folder: str, counts: DataFrame, files: Iterable[FileState]) -> str:
    spark = counts.sparkSession
    files = sorted(files)
    batch = _named(files)
    path = f"{folder}/{BATCHES}/{batch}/{COUNTS}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        counts.write.mode("overwrite").partitionBy(*CAMPAIGN_FOLDERS).parquet(path)
    rows = spark.createDataFrame([(batch, *file) for file in files], FILES_SCHEMA)
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/{FILES}")
    return batch


def update_report(
    spark: SparkSession, sources: Iterable[Source], folder: str
) -> dict[str, DataFrame]:
    """Bring the report under ``folder`` up to date with the sources' files; return its tables.

    The result is that of a report over all files. One run at a time may use a folder.
    """
    sources, folder = list(sources), folder.rstrip("/")
    present = present_files(spark, sources)
    batches = known_batches(spark, folder)
    chosen = usable_batches(batches, present)
    new = set(present).difference(*(batches[batch] for batch in chosen))
    if new:
        try:
            deliveries = read_campaigns(spark, sources, only=[path for path, *_ in new])
            counts = pace.count_enumerator_days(time_features(deliveries), by_shift=True)
            chosen.append(_write_batch(folder, counts, new))
        except NothingToReadError:
            # Blank files add nothing to what is there.
            if not chosen:
                raise
    if len(chosen) > MOST_BATCHES:
        chosen = [_write_batch(folder, _added_up(spark, folder, chosen), present)]
    days = _added_up(spark, folder, chosen)
    tables = f"{folder}/{TABLES}/{_named(chosen)}"
    return {ENUMERATOR_DAYS: days} | write_tables(days, tables)
