"""Connected components of an edge table, by alternating large and small stars.

Every round points the larger neighbours of a node, then the smaller ones, at the smallest of them.
Both are a minimum by node and a join, so a node with any number of neighbours is combined on the
map side and split by Spark; no list of neighbours is gathered. Rounds end when nothing changes,
after about the logarithm of the longest chain. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtempo.llm.storage import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (a, b), a < b."""
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        moved = both.join(least, "a").where(F.col("b") > F.col("a"))
        return moved.select(F.col("m").alias("a"), "b").distinct()
    # From each node to the smallest of its smaller neighbours, and these to it as well.
    down = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("m"))
    moved = edges.join(down, F.col("b") == F.col("node"))
    return (
        moved.select(F.col("m").alias("a"), F.col("a").alias("b"))
        .where(F.col("a") != F.col("b"))
        .unionAll(down.select(F.col("m").alias("a"), F.col("node").alias("b")))
        .distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0)).alias("x"),
    ).first()
    return row["n"], row["x"]


def component_roots(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots themselves; a root is the
    smallest node of its component."""
    edges = edges.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    edges = written(edges.distinct(), "components")
    last = _fingerprint(edges)
    for _ in range(most_rounds):
        edges = written(_star(_star(edges, large=True), large=False), "components")
        now = _fingerprint(edges)
        if now == last:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        last = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
