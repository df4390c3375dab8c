"""Mixing sources to target weights by capped water-filling.

A budget of words is shared among the sources by weight. No source may exceed a number of epochs of
its own words; sources above that are clamped there and their excess goes to the others by weight,
until none is above. A source with a target of 1.37 epochs gives each of its documents once, and a
seeded choice of documents, holding 0.37 of its words, once more.

The choice takes the documents in the order of a seeded hash until their words reach the quota. The
hash at which that happens is found by refining a histogram of the hash, three times by a factor of
4096, so no source is sorted or sent to one task. Rows that share the last hash, as repeated rows do,
are dealt: as many of them are taken as come nearest to the target. They are counted off by the tasks
that wrote them, so a group of any size is spread. The words taken are within half a document of the
target.

Null text has no words. Null is a source of its own, the last. A source without words has target 0
and gives nothing. Of repeated rows some may be taken once more than the others; which ones makes no
difference to the rows of the result. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtempo.llm.storage import free_names, small, written

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed by the contract of the query.
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
EPOCHS = 2.0
SEED = 20

STEP_BITS = 12
STEPS = 3
HASH_BITS = STEP_BITS * STEPS

PLAN = pa.schema(
    {
        "source": pa.string(),
        "source_size": pa.int64(),
        "target": pa.float64(),
        "whole": pa.int64(),
        "quota": pa.float64(),
    }
)


def water_fill(
    sizes: Sequence[int], weights: Sequence[float], budget: float, epochs: float
) -> list[float]:
    """Targets of the sources: the budget by weight, none above ``epochs`` times its size."""
    caps = [epochs * size for size in sizes]
    targets = [0.0] * len(sizes)
    free = {n for n, cap in enumerate(caps) if cap > 0}
    left = min(budget, sum(caps))
    while free:
        share = left / sum(weights[n] for n in free)
        above = {n for n in free if weights[n] * share >= caps[n]}
        if not above:
            for n in free:
                targets[n] = weights[n] * share
            break
        for n in above:
            targets[n] = caps[n]
        free -= above
        left = max(0.0, left - sum(caps[n] for n in above))
    return targets


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded(seed: int) -> Column:
    """A hash of 36 bits of the document."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 64 - HASH_BITS)


def source_targets(digest: DataFrame, budget: float, epochs: float) -> list[tuple]:
    """(source, size, target) by code point of the source, null last. There is a row for every
    source, so the list is as long as the list of sources."""
    rows = digest.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda row: (row["source"] is None, row["source"] or ""))
    sizes = [row["size"] for row in rows]
    weights = [WEIGHTS[n % len(WEIGHTS)] for n in range(len(rows))]
    targets = water_fill(sizes, weights, budget * sum(sizes), epochs)
    return [(row["source"], row["size"], target) for row, target in zip(rows, targets)]


def mixing_plan(
    digest: DataFrame, budget: float = BUDGET, epochs: float = EPOCHS
) -> tuple[DataFrame, int]:
    """A row for every source: ``source_size``, ``target``, ``whole`` repetitions, ``below``, the hash
    under which documents are taken once more, and ``rest``, the words that those of this hash are to
    give; and the number of sources.

    ``digest`` has ``source``, ``size`` and ``hash``, and is read several times.
    """
    spark = digest.sparkSession
    rows = []
    for source, size, target in source_targets(digest, budget, epochs):
        whole = int(target // size) if size else 0
        rows.append((source, size, target, whole, target - whole * size))
    # From Arrow the rows need no Python workers.
    columns = list(zip(*rows)) or [()] * len(PLAN)
    plan = spark.createDataFrame(
        pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, PLAN.types)], schema=PLAN)
    )
    # The quota still to fill, inside the documents whose hash starts with the prefix.
    state = plan.select("source", "quota", F.lit(0).cast("bigint").alias("prefix"))
    running = (
        Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    )
    for step in range(1, STEPS + 1):
        shift = HASH_BITS - STEP_BITS * step
        cell = F.shiftrightunsigned("hash", shift)
        inside = small(state.select(F.col("source").alias("of"), "quota", "prefix"), len(rows))
        sums = (
            digest.join(
                inside,
                F.col("source").eqNullSafe(F.col("of"))
                & (F.shiftrightunsigned("hash", shift + STEP_BITS) == F.col("prefix")),
            )
            .groupBy("source", "quota", "prefix", cell.alias("cell"))
            .agg(F.sum("size").alias("size"))
        )
        # At most 4096 cells a source. The cells that fit wholly come before the one that holds
        # the boundary, in which the next step looks closer.
        filled = sums.withColumn("filled", F.sum("size").over(running))
        first = (
            filled.where(F.col("filled") > F.col("quota"))
            .groupBy("source")
            .agg(
                F.min(F.struct("cell", "quota", "size", "filled")).alias("at"),
            )
            .select(
                "source",
                (F.col("at.quota") - F.col("at.filled") + F.col("at.size")).alias("quota"),
                F.col("at.cell").alias("prefix"),
                F.col("at.size").alias("size"),
            )
        )
        state = written(first, "mixing")
    edge = state.select(F.col("source").alias("of"), F.col("prefix").alias("below"), "quota")
    plan = plan.drop("quota").join(
        small(edge, len(rows)), F.col("source").eqNullSafe(F.col("of")), "left"
    )
    zero = F.lit(0).cast("bigint")
    plan = plan.select(
        "source",
        "source_size",
        "target",
        "whole",
        F.coalesce("below", zero).alias("below"),
        F.coalesce("quota", F.lit(0.0)).alias("rest"),
    )
    return written(plan, "mixing"), len(rows)


def _dealt(edge: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows of each source's last hash with ``more``, 1 for those taken once more.

    ``names`` are the columns of source, order, size, rest, row and the result. Rows of one order are
    alike; ``row`` tells the task that numbered them.
    """
    source, order, size, rest, row, more = names
    part, of_part, n, most, *of = free_names(
        [*edge.columns, more], "part", "of_part", "n", "most", "of_source", "of_order", "of_size"
    )
    parted = edge.withColumn(part, F.shiftright(row, 33))
    counted = parted.groupBy(source, order, size, rest, part).agg(F.count(F.lit(1)).alias(n))
    # Few orders share a hash, and each has a row for every task that has rows of it.
    before = (
        Window.partitionBy(source).orderBy(order, size, part).rowsBetween(Window.unboundedPreceding, -1)
    )
    room = F.col(rest) - F.coalesce(F.sum(F.col(n) * F.col(size)).over(before), F.lit(0))
    quotas = counted.select(
        *[F.col(c).alias(name) for c, name in zip((source, order, size), of)],
        F.col(part).alias(of_part),
        # The nearest number of rows; what a size of 0 adds makes no difference.
        F.floor(room / F.greatest(F.col(size), F.lit(1)) + 0.5).alias(most),
    )
    place = F.row_number().over(Window.partitionBy(source, order, size, part).orderBy(row))
    same = [F.col(c).eqNullSafe(F.col(name)) for c, name in zip((source, order, size, part), (*of, of_part))]
    return (
        parted.withColumn(more, place)
        .join(quotas, same)
        .select(*edge.columns, (F.col(more) <= F.col(most)).cast("bigint").alias(more))
    )


def _digest(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words(F.col("text")).alias("size"),
        seeded(seed).alias("hash"),
        F.xxhash64(F.lit(seed + 1), "doc_id", "text").alias("order"),
        F.monotonically_increasing_id().alias("row"),
    )


def mix(
    docs: DataFrame, seed: int = SEED, budget: float = BUDGET, epochs: float = EPOCHS
) -> DataFrame:
    """For every document its size, its source's size and target, and the words the mix takes."""
    digest = written(_digest(docs, seed), "mixing")
    plan, sources = mixing_plan(digest, budget, epochs)
    plan = small(plan.withColumnRenamed("source", "of"), sources)
    rows = digest.join(plan, F.col("source").eqNullSafe(F.col("of")))
    on_edge = F.col("hash") == F.col("below")
    edge = _dealt(rows.where(on_edge), ("source", "order", "size", "rest", "row", "more"))
    others = rows.where(~on_edge).withColumn("more", (F.col("hash") < F.col("below")).cast("bigint"))
    times = F.least(F.col("whole") + F.col("more"), F.lit(int(epochs)).cast("bigint"))
    return others.unionByName(edge).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, seed: int = SEED, budget: float = BUDGET, epochs: float = EPOCHS
) -> DataFrame:
    """The documents of the mix, each as often as the mix repeats it, with the same columns."""
    digest = written(_digest(docs, seed), "mixing")
    plan, sources = mixing_plan(digest, budget, epochs)
    inner = ("of", "whole", "below", "rest", "hash", "order", "size", "row", "more", "copy")
    of, whole, below, rest, hashed, order, size, row, more, copy = free_names(docs.columns, *inner)
    plan = plan.select(
        F.col("source").alias(of),
        F.col("whole").alias(whole),
        F.col("below").alias(below),
        F.col("rest").alias(rest),
    )
    rows = docs.withColumn(hashed, seeded(seed)).join(
        small(plan, sources), docs["source"].cast("string").eqNullSafe(F.col(of)), "inner"
    )
    on_edge = F.col(hashed) == F.col(below)
    edge = rows.where(on_edge).select(
        *rows.columns,
        F.xxhash64(F.lit(seed + 1), "doc_id", "text").alias(order),
        words(F.col("text")).alias(size),
        F.monotonically_increasing_id().alias(row),
    )
    dealt = _dealt(written(edge, "mixing-edge"), (of, order, size, rest, row, more))
    others = rows.where(~on_edge).withColumn(more, (F.col(hashed) < F.col(below)).cast("bigint"))
    times = F.least(F.col(whole) + F.col(more), F.lit(int(epochs)).cast("bigint"))
    return (
        others.unionByName(dealt, allowMissingColumns=True)
        .withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
        .select(*docs.columns)
    )
