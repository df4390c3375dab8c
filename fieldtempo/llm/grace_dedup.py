"""Exact deduplication by Grace hashing.

Records are dealt to buckets by a hash of their content, through shuffle files or, where one shuffle
would need too many partitions, through files of a coarse partition first. Each bucket goes through
an open-addressing table that compares complete content. A table that is full takes no new content:
what it cannot place goes to spill files in the shared folder and is dealt again by another hash,
until every bucket fits. Before the first deal a table of the same kind joins copies within each
task, so a content with any number of copies is sent at most once a task or flush.

Null content counts as empty. Of equal contents the row with the largest rank stays (null ranks
lowest); rows of equal rank are the same document repeated, and the one whose other columns sort
last stays. An empty table gives an empty table. Further columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, islice
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtempo.llm.batches import parts, releasing
from fieldtempo.llm.storage import free_names, new_path, written

#: Content that one table holds, in bytes of its strings. A single larger text still fits an empty table.
TABLE_BYTES = 64 << 20
#: Content that a table of the first, joining pass holds before it is emptied.
COMBINE_BYTES = 32 << 20
#: Partitions of one shuffle; more buckets than that are dealt through files first.
MOST_PARTITIONS = 8192
#: Folders of one such partition through files.
FILE_FAN_OUT = 64
#: Rows sent to Spark at a time are bounded by bytes too, so long texts make short batches.
OUT_BYTES = 8 << 20
#: What a record takes besides its text: short texts fill a table, too.
RECORD_BYTES = 400


class ContentTable:
    """Open addressing with linear probing; equal means equal hash and equal complete content."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[str] = []
        self.rows: list[tuple] = []
        self.counts: list[int] = []
        self.bytes = 0

    def find(self, hashed: int, content: str) -> int:
        """The number of the entry, or -1 - the free slot where it belongs."""
        mask = len(self.slots) - 1
        at = hashed & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == hashed and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        return -1 - at

    def insert(self, slot: int, hashed: int, content: str, row: tuple, count: int) -> None:
        self.slots[slot] = len(self.hashes)
        self.hashes.append(hashed)
        self.contents.append(content)
        self.rows.append(row)
        self.counts.append(count)
        self.bytes += getsizeof(content) + RECORD_BYTES
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()

    def replace(self, entry: int, content: str, row: tuple) -> None:
        """Another row of equal content; its text takes the place of the other one, or both are held."""
        self.contents[entry] = content
        self.rows[entry] = row

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for entry, hashed in enumerate(self.hashes):
            at = hashed & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _stays(row: tuple, other: tuple, rank: int) -> bool:
    """Whether a row stays rather than another of equal content."""
    mine, yours = row[rank], other[rank]
    if mine == yours:
        return repr(row) > repr(other)
    return yours is None or (mine is not None and mine > yours)


def _emitted(rows: Iterator[tuple], schema: pa.Schema, content: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[content] or "") + RECORD_BYTES
        if size >= OUT_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(columns, schema)], schema=schema
    )


def _task(
    content: int, rank: int, width: int, capacity: int, combine: bool, keep_content: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The work of one task: rows of ``width`` columns, then hash, count and the placed flag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()

        def entries() -> Iterator[tuple]:
            for row, hashed, count in zip(table.rows, table.hashes, table.counts):
                if not (combine or keep_content):
                    row = (*row[:content], None, *row[content + 1 :])
                yield (*row, hashed, count, True)

        def rows() -> Iterator[tuple]:
            full = False
            for part in chain.from_iterable(parts(batch, content) for batch in arrived()):
                for row in zip(*[column.to_pylist() for column in part.columns]):
                    hashed, count, row = row[width], row[width + 1], row[:width]
                    text = row[content] or ""
                    entry = table.find(hashed, text)
                    if entry >= 0:
                        table.counts[entry] += count
                        if _stays(row, table.rows[entry], rank):
                            table.replace(entry, text, row)
                        continue
                    if table.hashes and table.bytes + getsizeof(text) > capacity:
                        if not combine:
                            full = True
                        else:
                            yield from entries()
                            table.clear()
                            entry = table.find(hashed, text)
                    if full:
                        yield (*row, hashed, count, False)
                    else:
                        table.insert(-1 - entry, hashed, text, row, count)
            yield from entries()

        def arrived() -> Iterator[pa.RecordBatch]:
            # Not kept beyond its turn.
            yield first.pop()
            yield from batches

        first = [*islice(batches, 1)]
        if first:
            yield from _emitted(rows(), first[0].schema, content)

    return releasing(run)


def survivors(
    frame: DataFrame,
    content: str = "text",
    rank: str = "doc_id",
    size: str = "group_size",
    keep_content: bool = True,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """One row for every distinct content: the row that stays, and its group's size.

    Without ``keep_content`` the content column comes back null, which saves writing it.
    """
    spark = frame.sparkSession
    hashed, count, placed, total = free_names(frame.columns, "hash", "n", "placed", size)
    names = frame.columns
    places = {name.lower(): n for n, name in enumerate(names)}
    at = (places[content.lower()], places[rank.lower()], len(names))
    text = F.coalesce(F.col(content), F.lit(""))
    records = frame.select(
        "*",
        F.xxhash64(text).alias(hashed),
        F.lit(1).cast("bigint").alias(count),
        F.lit(True).alias(placed),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in records.schema])
    joined = records.mapInArrow(_task(*at, COMBINE_BYTES, True, True), schema)

    def measured(part: DataFrame, *by: str) -> DataFrame:
        size = F.octet_length(F.coalesce(F.col(content), F.lit(""))) + RECORD_BYTES
        return part.groupBy(*by).agg(F.sum(size).alias("volume"))

    def solved(part: DataFrame, volume: int, level: int, divides: bool = True) -> list[DataFrame]:
        digit = F.xxhash64(F.col(hashed), F.lit(level))
        buckets = -(-2 * volume // table_bytes) or 1
        if buckets > MOST_PARTITIONS and divides:
            path = new_path(spark, "grace")
            (folder,) = free_names(part.columns, "bucket")
            part.withColumn(folder, F.pmod(digit, F.lit(FILE_FAN_OUT))).write.partitionBy(
                folder
            ).parquet(path)
            typed = T.StructType([*schema, T.StructField(folder, T.IntegerType())])
            sizes = measured(spark.read.schema(typed).parquet(path), folder).collect()
            done = []
            for row in sizes:
                bucket = spark.read.schema(schema).parquet(f"{path}/{folder}={row[folder]}")
                # Copies of one content stay together however often they are dealt; a table takes
                # any number of them.
                done += solved(bucket, row["volume"], level + 1, len(sizes) > 1)
            return done
        dealt = part.repartition(max(min(buckets, MOST_PARTITIONS), least), digit)
        tried = written(
            dealt.mapInArrow(_task(*at, table_bytes, False, keep_content), schema), "grace"
        )
        spilled = tried.where(~F.col(placed))
        rest = measured(spilled).first()["volume"]
        found = tried.where(F.col(placed))
        return [found, *(solved(spilled, rest, level + 1) if rest else [])]

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = reduce(DataFrame.unionAll, solved(joined, measured(frame).first()["volume"] or 0, 0))
    return kept.select(*names, F.col(count).alias(total))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of its text.

    Groups come from the tables; rows find theirs by the SHA-256 of the content, in a join that
    Spark can split where a third of all rows share one text. Of repeated rows one is kept, the
    first to be numbered; it comes from an aggregate that tasks combine beforehand.
    """
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn(
        "text_sha256", sha
    )
    groups = survivors(rows, keep_content=False).select(
        "text_sha256", F.col("doc_id").alias("keep_id"), "group_size"
    )
    digest = written(
        rows.select("doc_id", "text_sha256", F.monotonically_increasing_id().alias("row")), "grace-rows"
    )
    # A null id is smaller than any other.
    last = F.max(F.struct(F.col("doc_id"), (-F.col("row")).alias("back")))
    kept = digest.groupBy("text_sha256").agg((-last["back"]).alias("keep_row"))
    return digest.join(groups.join(kept, "text_sha256"), "text_sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        "text_sha256",
    )
