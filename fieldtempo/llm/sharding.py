"""Contiguous shards of ordered atomic groups, the largest as small as can be.

Rows with equal text form an atomic group; groups are ordered by a 64-bit hash of the text. The
smallest capacity at which a greedy pass needs no more than the given number of shards is found by
binary search, and the greedy cuts at that capacity become boundaries in hash order.

The pass needs prefix sums of group sizes, of which there are too many for the driver. It starts
from the sums of hash prefixes, a fixed number of them, and asks Spark for finer sums only of those
prefixes in which a cut can lie. What the driver holds depends on the number of shards alone.

Null text counts as empty. Repeated rows count each. An empty table gives no rows. A group larger
than its share gets a shard to itself and its neighbours the rest, so shards may then stay empty.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtempo.llm.storage import written

FIRST_BITS = 14
MORE_BITS = 8
KEY_BITS = 64
#: Rows that one task numbers.
SLOT_ROWS = 500_000


@dataclass(frozen=True)
class Node:
    """The groups whose keys begin with ``prefix`` of so many bits; one of them alone if atomic."""

    prefix: int
    bits: int
    size: int
    first: int
    last: int

    @property
    def atomic(self) -> bool:
        return self.first == self.last


def _ordered(key: int) -> int:
    """A signed 64-bit key as a number from 0 in the same order."""
    return key + (1 << (KEY_BITS - 1))


def _prefix(key: Column, bits: int) -> Column:
    flipped = key.bitwiseXOR(F.lit(-(1 << (KEY_BITS - 1))))
    return F.shiftrightunsigned(flipped, KEY_BITS - bits)


def _nodes(digest: DataFrame, bits: int) -> list[Node]:
    rows = (
        digest.groupBy(_prefix(F.col("key"), bits).alias("prefix"))
        .agg(F.sum("size").alias("size"), F.min("key").alias("first"), F.max("key").alias("last"))
        .collect()
    )
    return [
        Node(row["prefix"], bits, row["size"], _ordered(row["first"]), _ordered(row["last"]))
        for row in rows
    ]


class _Pass:
    """Greedy passes over the nodes; a cut inside a node may lie at its start or at its end."""

    def __init__(self, nodes: list[Node], shards: int):
        self.nodes = sorted(nodes, key=lambda node: node.first)
        self.sums = [0, *accumulate(node.size for node in self.nodes)]
        self.shards = shards

    def cuts(self, capacity: int, late: bool) -> list[int]:
        """Node numbers before which to cut; more than shards - 1 if the capacity is too small."""
        at, found = 0, []
        while self.sums[-1] - self.sums[at] > capacity and len(found) < self.shards:
            end = bisect_right(self.sums, self.sums[at] + capacity) - 1
            if late and not self.nodes[end].atomic:
                end += 1
            found.append(max(end, at))
            if end <= at:
                return [*found, *[at] * self.shards]
            at = end
        return found

    def fits(self, capacity: int, late: bool) -> bool:
        return len(self.cuts(capacity, late)) < self.shards

    def smallest(self, late: bool) -> int:
        low, high = 0, self.sums[-1]
        while low < high:
            middle = (low + high) // 2
            if self.fits(middle, late):
                high = middle
            else:
                low = middle + 1
        return low

    def open_nodes(self) -> list[int]:
        """Numbers of the nodes in which a cut can lie, at any capacity still possible."""
        least, most = self.smallest(late=True), self.smallest(late=False)
        found: set[int] = set()
        begin = finish = 0
        for _ in range(self.shards - 1):
            begin = self._end(begin, least, late=False)
            finish = self._end(finish, most, late=True)
            found.update(range(begin, min(finish + 1, len(self.nodes))))
        return sorted(n for n in found if not self.nodes[n].atomic)

    def _end(self, start: int, capacity: int, late: bool) -> int:
        """Where the shard that starts at a node ends."""
        if start >= len(self.nodes):
            return start
        end = max(start, bisect_right(self.sums, self.sums[start] + capacity) - 1)
        if late and end < len(self.nodes) and not self.nodes[end].atomic:
            end += 1
        return end


def minimax_boundaries(digest: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the ordered keys at which shards 1, 2, ... begin.

    ``digest`` has bigint columns ``key`` (order and identity of the group) and ``size``.
    """
    nodes = _nodes(digest, FIRST_BITS)
    while True:
        greedy = _Pass(nodes, shards)
        split = greedy.open_nodes()
        if not split:
            break
        nodes = _refined(digest, greedy.nodes, split)
    capacity = greedy.smallest(late=False)
    return capacity, [greedy.nodes[n].first for n in greedy.cuts(capacity, late=False)]


def _refined(digest: DataFrame, nodes: list[Node], split: list[int]) -> list[Node]:
    """The nodes with those numbered in ``split`` replaced by their children."""
    kept = [node for n, node in enumerate(nodes) if n not in set(split)]
    by_bits: dict[int, list[int]] = {}
    for n in split:
        by_bits.setdefault(nodes[n].bits, []).append(nodes[n].prefix)
    for bits, prefixes in by_bits.items():
        inside = digest.where(_prefix(F.col("key"), bits).isin(prefixes))
        kept += _nodes(inside, min(KEY_BITS, bits + MORE_BITS))
    return kept


def shard_of(key: Column, boundaries: list[int]) -> Column:
    """The shard of a signed key: the number of boundaries at or below it."""
    shard = F.lit(0)
    for boundary in boundaries:
        signed = F.lit(boundary - (1 << (KEY_BITS - 1))).cast("bigint")
        shard = shard + (key >= signed).cast("int")
    return shard


def text_digest(docs: DataFrame, name: Callable[[str], str] = str) -> DataFrame:
    """One small row per document: doc_id, size, text_crc32 and the order key of its group."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def minimax_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The digest of every document with its ``shard`` and its ``slot``, gapless in each shard.

    Slots are dealt by a hash of the row's number, so copies of one text, which share a shard, and
    repeated rows are numbered by many tasks.
    """
    digest = written(
        text_digest(docs).withColumn("row", F.monotonically_increasing_id()), "sharding"
    )
    _, boundaries = minimax_boundaries(digest, shards)
    rows = digest.count()
    salts = max(16, -(-rows // SLOT_ROWS))
    placed = digest.withColumn("shard", shard_of(F.col("key"), boundaries)).withColumn(
        "salt", F.pmod(F.xxhash64("row", F.lit(8)), F.lit(salts))
    )
    # shards * salts rows, so one for every 62,500 documents of a large table.
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "salt").orderBy("doc_id", "key", "row")
    return placed.join(offsets, ["shard", "salt"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("offset") + F.row_number().over(within) - 1).alias("slot"),
    )
