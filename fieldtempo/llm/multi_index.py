"""Approximate nearest neighbours by inner product over an inverted multi-index.

Vectors are cut into halves, each quantised by its own centroids; a pair of centroids is a cell. A
query visits cells in the order of the summed distance of their two centroids, which a heap yields
from the two sorted lists, until the cells hold the wanted share of all entries. These entries are
reranked by the exact inner product in double precision, ties to the smaller id.

The centroids are fitted on a bounded sample. So is the share: it is the least at which the sample's
own neighbours are found to the wanted recall, so that loosely clustered vectors are searched widely
and clustered ones narrowly. Every vector is indexed. Cells next to each other are packed to blocks,
and a cell with more entries than a block takes is split over several; a block that many queries
visit is copied to as many tasks as they need. What a task holds is bounded, no candidate is dropped.

Vectors that are null, zero, hold a null or a non-finite component, or differ in length from most,
take no part. Repeated ids are candidates each; a query's own id is not among its candidates. Every row
that asks has a list of its own, so repeated rows, or several vectors of one id, give as many lists
under their id. Rows are dealt by numbers of their own, whatever their ids. Fewer candidates than
wanted give all of them. Further columns may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtempo.llm.storage import small, written

CENTROIDS = 64
ROUNDS = 12
#: Numbers in the sample that the index is fitted on; the bound of the sample.
SAMPLE_NUMBERS = 2_000_000
SAMPLE_QUERIES = 256
#: Recall that the share of entries to visit is fitted to.
RECALL = 0.95
#: Entries of a block, and queries that one task holds against it.
BLOCK_ENTRIES = 4096
TASK_QUERIES = 2048
NEIGHBOURS = 20
QUERY_DIVISOR = 20
SEED = 11


def nearest_centroids(half: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (half @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)


def fit_centroids(half: np.ndarray, number: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from distinct points of the sample; a centroid without points stays."""
    distinct = np.unique(half, axis=0)
    pick = np.random.default_rng(seed).permutation(len(distinct))[:number]
    centroids = distinct[np.sort(pick)]
    for _ in range(ROUNDS):
        nearest = nearest_centroids(half, centroids)
        counts = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, half)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


@dataclass
class MultiIndex:
    """Centroids of both halves; entries, block and split of each cell; entries to visit."""

    first: np.ndarray
    second: np.ndarray
    share: float
    entries: np.ndarray
    block: np.ndarray
    splits: np.ndarray

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a = nearest_centroids(vectors[:, : self.half], self.first)
        b = nearest_centroids(vectors[:, self.half :], self.second)
        return a * len(self.second) + b

    def visited(self, query: np.ndarray) -> np.ndarray:
        """Cells in the order of the summed distance, until enough entries are seen."""
        da = -(self.first @ query[: self.half])
        db = -(self.second @ query[self.half :])
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        da, db, oa, ob = da[oa].tolist(), db[ob].tolist(), oa.tolist(), ob.tolist()
        wanted, width = self.share * float(self.entries.sum()), len(ob)
        entries = self.entries
        found, seen = [], 0
        heap = [(da[0] + db[0], 0, 0)]
        while heap and seen < wanted:
            _, i, j = heapq.heappop(heap)
            cell = oa[i] * width + ob[j]
            if entries[cell]:
                found.append(cell)
                seen += int(entries[cell])
            if j + 1 < width:
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            # A row is opened when the one before it is.
            if j == 0 and i + 1 < len(oa):
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
        return np.array(found, np.int64)

    def blocks(self, cells: np.ndarray) -> list[int]:
        found: set[int] = set()
        for cell in cells.tolist():
            found.update(range(self.block[cell], self.block[cell] + self.splits[cell]))
        return sorted(found)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec, size) of the vectors that can take part."""
    rows = vectors.select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec")
    ).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    finite = F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    nonzero = F.exists("vec", lambda x: x != 0)
    return rows.where(finite & nonzero).withColumn("size", F.size("vec"))


def _plan(index: MultiIndex, entries: np.ndarray) -> MultiIndex:
    """Packs the cells, in their order, to blocks."""
    index.entries = entries
    index.block = np.zeros(len(entries), np.int64)
    index.splits = np.maximum(1, -(-entries // BLOCK_ENTRIES))
    block, held = 0, 0
    for cell, n in enumerate(entries.tolist()):
        if held and held + n > BLOCK_ENTRIES:
            block, held = block + 1, 0
        index.block[cell] = block
        held += n
        if index.splits[cell] > 1:
            block, held = block + int(index.splits[cell]), 0
    return index


def fit(rows: DataFrame, count: int, dimension: int, neighbours: int = NEIGHBOURS) -> MultiIndex:
    """Centroids and the share to visit, from a sample of bounded size."""
    wanted = max(1, SAMPLE_NUMBERS // dimension)
    threshold = min(1 << 32, int((1 << 32) * 1.1 * wanted / max(1, count)) + 1)
    hashed = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 32))
    drawn = rows.select("id", "vec", hashed.alias("h")).where(F.col("h") < threshold)
    sample = drawn.orderBy("h", "id").limit(wanted).select("vec").collect()
    vectors = np.array([row["vec"] for row in sample], float).reshape(len(sample), dimension)
    half = max(1, dimension // 2)
    number = max(1, min(CENTROIDS, len(vectors) // 4))
    index = MultiIndex(
        fit_centroids(vectors[:, :half], number, SEED),
        fit_centroids(vectors[:, half:], number, SEED + 1),
        1.0,
        np.zeros(0, np.int64),
        np.zeros(0, np.int64),
        np.zeros(0, np.int64),
    )
    index.share = _share(index, vectors, neighbours)
    return index


def _share(index: MultiIndex, vectors: np.ndarray, neighbours: int) -> float:
    """The share of entries within which the wanted part of the sample's neighbours lies."""
    if len(vectors) < 10 * neighbours:
        return 1.0
    cells = index.cells(vectors)
    index.entries = np.bincount(cells, minlength=len(index.first) * len(index.second))
    behind = []
    for n in range(0, len(vectors), max(1, len(vectors) // SAMPLE_QUERIES)):
        scores = vectors @ vectors[n]
        scores[n] = -np.inf
        best = np.argpartition(-scores, neighbours)[:neighbours]
        order = index.visited(vectors[n])
        reached = np.zeros(len(index.entries))
        reached[order] = np.cumsum(index.entries[order]) / len(vectors)
        behind.append(reached[cells[best]])
    return float(np.quantile(np.concatenate(behind), RECALL))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def search(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found of every query; ``is_query`` is a
    condition on ``id``."""
    spark = vectors.sparkSession
    numbered = usable(vectors, key, vector).withColumn("row", F.monotonically_increasing_id())
    rows = written(numbered, "multi_index")
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dimension, count = sizes["size"], sizes["count"]
    rows = rows.where(F.col("size") == dimension).select("id", "vec", "row")
    index = fit(rows, count, dimension, neighbours)
    cells = spark.sparkContext.broadcast(index)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = cells.value.cells(_matrix(batch.column(1), dimension))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found)], names=["id", "vec", "row", "cell"]
            )

    entries = written(
        rows.mapInArrow(assigned, "id bigint, vec array<double>, row bigint, cell bigint"),
        "multi_index",
    )
    # At most as many rows as there are pairs of centroids.
    counted = np.zeros(len(index.first) * len(index.second), np.int64)
    for row in entries.groupBy("cell").count().collect():
        counted[row["cell"]] = row["count"]
    plan = spark.sparkContext.broadcast(_plan(index, counted))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = plan.value
        for batch in batches:
            blocks, masks = [], []
            for query in _matrix(batch.column(1), dimension):
                seen = known.visited(query)
                mask = np.zeros(len(known.entries), bool)
                mask[seen] = True
                blocks.append(known.blocks(seen))
                masks.append(np.packbits(mask).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(blocks, pa.list_(pa.int64())),
                    pa.array(masks, pa.binary()),
                ],
                names=["id", "vec", "row", "blocks", "mask"],
            )

    asked = (
        rows.where(is_query)
        .mapInArrow(
            visits, "id bigint, vec array<double>, row bigint, blocks array<bigint>, mask binary"
        )
        .withColumn("block", F.explode("blocks"))
        .drop("blocks")
    )
    asked = written(asked, "multi_index")
    parts = written(
        asked.groupBy("block")
        .count()
        .select("block", F.ceil(F.col("count") / TASK_QUERIES).cast("int").alias("parts")),
        "multi_index",
    )
    parts_hint = small(parts, parts.count())
    cell_plan = spark.createDataFrame(
        [
            (cell, int(index.block[cell]), int(index.splits[cell]))
            for cell in np.flatnonzero(counted).tolist()
        ],
        "cell bigint, first bigint, splits bigint",
    )
    left = (
        entries.join(F.broadcast(cell_plan), "cell")
        .withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("splits")))
        .join(parts_hint, "block")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("block", "part", "id", "vec", "cell")
    )
    right = (
        asked.join(parts_hint, "block")
        .withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
        .select("block", "part", "id", "row", "vec", "mask")
    )

    def reranked(_: tuple, there: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if there.num_rows and queries.num_rows:
            ids = there["id"].to_numpy()
            cell = there["cell"].to_numpy()
            matrix = _matrix(there["vec"], dimension)
            asking, asking_row = queries["id"].to_numpy(), queries["row"].to_numpy()
            vectors = _matrix(queries["vec"], dimension)
            for start in range(0, len(asking), 256):
                some = slice(start, start + 256)
                masks = np.stack(
                    [np.frombuffer(m, np.uint8) for m in queries["mask"][some].to_pylist()]
                )
                seen = np.unpackbits(masks, axis=1)[:, cell].astype(bool)
                scores = vectors[some] @ matrix.T
                seen &= asking[some][:, None] != ids[None, :]
                scores[~seen] = -np.inf
                places = np.arange(len(asking))[some]
                found += _best(places, ids, matrix, vectors[some], scores, neighbours)
        return pa.table(
            {
                "query_id": pa.array([asking[x[0]] for x in found], pa.int64()),
                "row": pa.array([asking_row[x[0]] for x in found], pa.int64()),
                "vec_id": pa.array([x[1] for x in found], pa.int64()),
                "score": pa.array([x[2] for x in found], pa.float64()),
            }
        )

    partial = (
        left.groupBy("block", "part")
        .cogroup(right.groupBy("block", "part"))
        .applyInArrow(reranked, "query_id bigint, row bigint, vec_id bigint, score double")
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= neighbours)
        .select("query_id", "rank", "vec_id", "score")
    )


def _best(
    asking: np.ndarray,
    ids: np.ndarray,
    matrix: np.ndarray,
    vectors: np.ndarray,
    scores: np.ndarray,
    neighbours: int,
) -> list[tuple[int, int, float]]:
    """The best candidates of each query. A product of matrices may sum in another order than that of
    two vectors, so candidates within rounding of the last one are kept and measured one by one."""
    found = []
    for n, query in enumerate(asking.tolist()):
        row = scores[n]
        finite = int(np.isfinite(row).sum())
        if not finite:
            continue
        k = min(neighbours, finite)
        least = np.partition(row, len(row) - k)[len(row) - k]
        near = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)))
        exact = _measure(matrix[near], vectors[n])
        order = np.lexsort((ids[near], -exact))[:neighbours]
        found += [(query, int(ids[near[i]]), float(exact[i])) for i in order]
    return found


def _measure(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed alike wherever it is computed, so copies have equal scores."""
    return np.cumsum(matrix * query, axis=1)[:, -1]
