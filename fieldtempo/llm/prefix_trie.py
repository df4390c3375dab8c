"""The prefix trie of conversations, from their sorted order, without building a tree.

Conversations are sequences of turns, here of digests of role and text. In sorted order those that
begin alike are neighbours, and a prefix of d turns is an interval in which neighbours share at least d
turns. The numbers of shared turns (LCP) lie in a sparse table of range minima. Every candidate, a
conversation and a depth, finds both ends of its interval by a binary search of its own; a node is
taken from its first member. What is asked of a node comes from sums and minima over its interval.

The order is cut into blocks, one for a task. An interval that goes on beyond its block is cut there
as well; its pieces have the digest of the prefix as a common name, by which they are added up. Only
prefixes of a block's first and last conversation can be cut.

Turns of equal number are ordered by digest, null numbers first; null roles and texts are empty. Rows
without a conv_id take no part, repeated rows are turns of their own. A conversation's digests, not its
texts, must fit a task. An empty table has no node, not even a root. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtempo.llm.storage import small, written

#: Bytes of a turn's digest.
TURN = 16
HEAD_OF = 5
MOST_HEAD = 9
#: Turns that a block holds, about.
BLOCK_TURNS = 200_000

KEYED = "conv_id bigint, key binary, sizes array<bigint>"
PIECES = (
    "id binary, parent binary, block int, ids string, conv_id bigint, depth bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
NODE = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """Each conversation's turns in order: digests in hex, and the bytes of the texts."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return (
        conversations.select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            F.struct(
                F.col("turn").alias("turn"),
                F.substring(F.sha2(named.cast("binary"), 256), 1, 2 * TURN).alias("digest"),
                F.octet_length(text).cast("bigint").alias("size"),
            ).alias("step"),
        )
        .where("conv_id is not null")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("step")).alias("turns"))
        .select(
            "conv_id",
            F.transform("turns", lambda x: F.struct(x["digest"], x["size"])).alias("turns"),
        )
    )


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of another: that of the next lower multiple of
    five lends as many as the id's CRC-32 says, and the own turns after as many follow."""
    heads = own.where(F.col("conv_id") % HEAD_OF == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_HEAD - 1).alias("head")
    )
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_HEAD)).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % HEAD_OF).join(
        heads, "base", "left"
    )
    begin = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(begin, rest).alias("turns"))


def keyed(turns: DataFrame) -> DataFrame:
    """Sequences as one binary key each; keys compare as the sequences of digests do."""
    return turns.select(
        "conv_id",
        F.unhex(F.array_join(F.col("turns.digest"), "")).alias("key"),
        F.col("turns.size").alias("sizes"),
    )


def shared_turns(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle
    return low


def _with_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the block, the place in it and the turns shared with the row before, in a sorted block."""
    block, place, before = TaskContext.get().partitionId(), 0, b""
    for batch in batches:
        keys = batch.column("key").to_pylist()
        shared = [shared_turns(a, b) for a, b in zip([before, *keys], keys)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(keys), block, np.int32)),
                pa.array(np.arange(place, place + len(keys))),
                pa.array(shared, pa.int64()),
                *batch.columns,
            ],
            names=["block", "place", "lcp", *batch.schema.names],
        )
        place, before = place + len(keys), keys[-1] if keys else before


def sorted_blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``KEYED`` in sorted order, cut into blocks; equal sequences are ordered by id."""
    spark = rows.sparkSession
    turns = rows.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // BLOCK_TURNS))
    ordered = rows.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return written(
        ordered.mapInArrow(_with_shared, f"block int, place bigint, lcp bigint, {KEYED}"), "trie-blocks"
    )


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        shared = pa.array([shared_turns(a, b) for a, b in pairs], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), shared], names=["block", "lcp"])


def shared_with_block_before(blocks: DataFrame) -> dict[int, int]:
    """By block, the turns that its first row shares with the one before; -1 for the first block.

    The driver gets two numbers for each block, of which each holds many rows.
    """
    spark = blocks.sparkSession
    edges = written(
        blocks.groupBy("block").agg(
            F.min_by("key", "place").alias("first"), F.max_by("key", "place").alias("last")
        ),
        "trie-edges",
    )
    held = sorted(row[0] for row in edges.select("block").collect())
    if not held:
        return {}
    order = spark.createDataFrame(list(zip(held, held[1:])), "block int, next int")
    pairs = (
        edges.select("block", "last")
        .join(F.broadcast(order), "block")
        .select(F.col("next").alias("block"), "last")
        .join(edges.select("block", "first"), "block")
        .mapInArrow(_between, "block int, lcp bigint")
    )
    return {held[0]: -1} | {row["block"]: row["lcp"] for row in pairs.collect()}


class RangeMinimum:
    """A sparse table: the minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 ** len(self.rows) <= len(values):
            half = 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def over(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minimum from first to last, both included, for each pair."""
        level = np.frexp(last - first + 1)[1] - 1
        found = np.empty(len(first), self.rows[0].dtype)
        for k in np.unique(level):
            some = level == k
            row = self.rows[k]
            found[some] = np.minimum(row[first[some]], row[last[some] - 2**k + 1])
        return found

    def right(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place up to which all values after ``start`` are at least ``least``."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            inside = at + 2**k < len(self.rows[0])
            inside[inside] = row[at[inside] + 1] >= least[inside]
            at[inside] += 2**k
        return at

    def left(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place after which all values up to ``start`` are at least ``least``."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            inside = at - 2**k >= 0
            inside[inside] = row[at[inside] - 2**k + 1] >= least[inside]
            at[inside] -= 2**k
        return at


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


@dataclass
class Block:
    """Neighbouring conversations in sorted order. ``lcp`` begins with the turns shared with the
    conversation before the block, ``after`` are those shared with the one behind; -1 is none."""

    number: int
    conv_id: np.ndarray
    keys: list[bytes]
    sizes: list[np.ndarray]
    lcp: np.ndarray
    after: int

    def pieces(self) -> dict[str, list]:
        """The nodes that begin in the block, and the parts here of those that began before."""
        rows, lcp = len(self.keys), self.lcp
        turns = np.array([len(key) // TURN for key in self.keys], np.int64)
        low = np.maximum(lcp, 0)
        # Row 0 stands for all its prefixes; other rows for those the row before lacks, and the parent.
        low[0] = 0
        offset = _sums(turns - low + 1)
        row = np.repeat(np.arange(rows), turns - low + 1)
        depth = np.arange(offset[-1]) - offset[row] + low[row]
        table = RangeMinimum(lcp)
        first, last = table.left(row, depth), table.right(row, depth)
        open_left = (first == 0) & (lcp[0] >= depth)
        open_right = (last == rows - 1) & (self.after >= depth)
        closed = ~(open_left | open_right)

        # Bytes of a row's first turns: those of the prefix, and those shared with the row before.
        before = _sums(np.concatenate([np.empty(0, np.int64), *self.sizes]))
        begin = _sums(turns)
        shared = before[begin[:-1] + np.maximum(lcp, 0)] - before[begin[:-1]]
        above = before[begin[row] + np.maximum(depth - 1, 0)] - before[begin[row]]
        sums = _sums(shared)
        from_row = np.where(open_left, 0, first + 1)
        saved = sums[last + 1] - sums[from_row] - (last + 1 - from_row) * above
        leaves = _sums(np.append(lcp[1:], self.after) < turns)
        n_leaves = leaves[last + 1] - leaves[first]
        smallest = RangeMinimum(self.conv_id).over(first, last)

        node = (depth > low[row]) | (row == 0)
        starts = np.flatnonzero((depth > lcp[row]) & (depth > 0))
        up = starts - 1  # the same row's candidate one turn shorter
        parents = offset[first[up]] + depth[up] - low[first[up]]
        children = np.bincount(parents, minlength=len(row))

        kept = np.flatnonzero(node)
        parent_closed = np.zeros(len(row), bool)
        parent_closed[1:] = closed[:-1]
        ends = self._ends(turns)
        out: dict[str, list] = {
            "conv_id": smallest[kept].tolist(),
            "depth": depth[kept].tolist(),
            "n_convs": (last - first + 1)[kept].tolist(),
            "n_children": children[kept].tolist(),
            "n_leaves": n_leaves[kept].tolist(),
            "saved_tokens": saved[kept].tolist(),
            "block": [self.number] * len(kept),
        }
        ids, parent, joined, parent_conv_id, hashes = [], [], [], [], []
        for q in kept.tolist():
            i, d = int(row[q]), int(depth[q])
            members = ends[i] if d == turns[i] else ""
            whole = bool(closed[q])
            ids.append(None if whole else self.name(i, d))
            joined.append(None if whole else members)
            hashes.append(hashlib.sha256(members.encode()).hexdigest() if whole else None)
            near = d > 0 and bool(parent_closed[q])
            parent_conv_id.append(int(smallest[q - 1]) if near else None)
            parent.append(self.name(i, d - 1) if d > 0 and not near else None)
        return out | {
            "id": ids,
            "parent": parent,
            "ids": joined,
            "parent_conv_id": parent_conv_id,
            "ends_sha256": hashes,
        }

    def name(self, row: int, depth: int) -> bytes:
        return hashlib.sha256(self.keys[row][: depth * TURN]).digest()

    def _ends(self, turns: np.ndarray) -> dict[int, str]:
        """The ids of equal sequences, by the first row of each run of them."""
        new = np.ones(len(turns), bool)
        new[1:] = (self.lcp[1:] != turns[1:]) | (turns[1:] != turns[:-1])
        edges = np.append(np.flatnonzero(new), len(turns)).tolist()
        return {
            start: ",".join(map(str, self.conv_id[start:end].tolist()))
            for start, end in zip(edges, edges[1:])
        }


_ARROW = pa.schema(
    [
        ("id", pa.binary()),
        ("parent", pa.binary()),
        ("block", pa.int32()),
        ("ids", pa.string()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()),
    ]
)


def pieces(blocks: DataFrame, edges: dict[int, int]) -> DataFrame:
    """The pieces of all nodes, each block in one task, by its number."""
    held = sorted(edges)
    after = {a: edges[b] for a, b in zip(held, held[1:])}

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        number = rows["block"][0].as_py()
        lcp = rows["lcp"].to_numpy().copy()
        lcp[0] = edges[number]
        block = Block(
            number,
            rows["conv_id"].to_numpy(),
            rows["key"].to_pylist(),
            [np.array(sizes, np.int64) for sizes in rows["sizes"].to_pylist()],
            lcp,
            after.get(number, -1),
        )
        yield pa.RecordBatch.from_pydict(block.pieces(), schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for start, end in zip(cuts, cuts[1:]):
                if held and end > start and held[-1].column("block")[0].as_py() != numbers[start]:
                    yield from found(held)
                    held = []
                if end > start:
                    held.append(batch.slice(start, end - start))
        if held:
            yield from found(held)

    return (
        blocks.repartitionById(max(held, default=0) + 1, "block")
        .sortWithinPartitions("block", "place")
        .mapInArrow(run, PIECES)
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each id of the comma-joined ids of its pieces, which come in order."""
    now, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != now:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = name, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digests(done)
    if state is not None:
        yield _digests([(now, state.hexdigest())])


def _digests(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())],
        names=["id", "ends_sha256"],
    )


def _put_together(parts: DataFrame) -> DataFrame:
    """Nodes of several pieces. There are as many as blocks have prefixes at their edges."""
    ends = (
        parts.where("ids != ''")
        .select("id", "ids", "block")
        .repartition("id")
        .sortWithinPartitions("id", "block")
        .select("id", "ids")
        .mapInArrow(_hashed, "id binary, ends_sha256 string")
    )
    sums = parts.groupBy("id").agg(
        F.first("parent").alias("parent"),
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    return sums.join(ends, "id", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))
    )


def trie_nodes(turns: DataFrame) -> DataFrame:
    """The nodes of the trie over sequences of (conv_id, turns), as ``NODE``."""
    blocks = sorted_blocks(written(keyed(turns), "trie-keys"))
    found = written(pieces(blocks, shared_with_block_before(blocks)), "trie-pieces")
    merged = written(_put_together(found.where("id is not null")), "trie-merged")
    known = small(
        merged.select(F.col("id").alias("parent"), F.col("conv_id").alias("up")), merged.count()
    )
    whole = found.where("id is null").select("parent", *NODE)
    near = whole.where("parent is null").select(*NODE)
    far = whole.drop("parent_conv_id").where("parent is not null")
    cut = merged.drop("id")
    joined = far.unionByName(cut).join(known, "parent", "left").withColumnRenamed("up", "parent_conv_id")
    return near.unionByName(joined.select(*NODE))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    own = written(sequences(conversations), "trie-turns")
    return trie_nodes(rebuilt(own))
