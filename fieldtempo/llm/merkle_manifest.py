"""A Merkle manifest of a table: one root for all rows, and for each row a proof that it is in it.

Every row is a leaf. The leaves of a language, in the order of their ids, form a tree in which every
eight consecutive nodes have one parent; the roots of these trees, in the order of the languages, form
one more. Proofs come from pointer jumping: each node holds the segment of siblings on the way to an
ancestor, one level up to begin with. Joining the nodes with themselves on that ancestor appends its
segment, which doubles the distance, so the longest path takes the logarithm of its length in joins.

Digests are lower-case hex text where they are hashed and shown, and raw bytes in segments. Null
fields hash as "-". Null ids come first in their language and are never tampered with; rows of one id
in one language are ordered by leaf, equal rows are leaves of their own. Null is a language of its
own, before the empty string. An empty table has no rows. Columns other than ``FIELDS`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtempo.llm.storage import small, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
#: The tree over the languages' roots; those below it are numbered from 0.
TOP = -1
TAMPERED_OF = 3
#: Rows that one task sorts, at most about.
SORT_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A segment's one level counts as so many numbers when a table is broadcast.
LEVEL_WEIGHT = 8


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Each field as its length in bytes and itself, so that no two lists of fields run together."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(F.concat(*parts))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, the ordering key of its language, and its leaf before and after tampering."""
    doc_id = F.col("doc_id").cast("bigint")
    whole = [doc_id if name == "doc_id" else F.col(name) for name in FIELDS]
    lowered = [F.translate(c, UPPER, LOWER) if n == "text" else c for n, c in zip(FIELDS, whole)]
    tampered = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(TAMPERED_OF)) == 0
    leaf = leaf_digest(whole)
    return docs.select(
        doc_id.alias("doc_id"),
        # The mark before a value keeps null apart from, and before, the empty string.
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("group"),
        leaf.alias("leaf"),
        F.when(tampered, leaf_digest(lowered)).otherwise(leaf).alias("shown"),
    )


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The written rows with ``pos``, from 0 in each group, and the group's ``size``.

    Tasks number ranges of rows, so a group of any size is spread; rows equal in all columns are told
    apart by where they stand in the table, and are spread as well.
    """
    spark = rows.sparkSession
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SORT_ROWS)
    )
    by = [group, *order, "row"]
    numbered = written(
        rows.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .drop("row")
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("row", 33)),
        "merkle-order",
    )
    counted = numbered.groupBy(group, "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("first")
    )
    # A group has at most one row for each range here.
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        counted.select(
            group,
            "part",
            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("n").over(whole).alias("size"),
        ),
        "merkle-starts",
    )
    joined = numbered.join(small(starts, starts.count()), [group, "part"])
    return joined.withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "shift")


@dataclass
class Forest:
    """Trees built level by level. ``levels`` holds each level's runs of siblings, ``roots`` the
    (tree, hash) of every tree, ``height`` the longest way up."""

    levels: list[DataFrame]
    roots: DataFrame
    height: int


def forest(nodes: DataFrame) -> Forest:
    """Trees over rows of (tree, pos, size, hash), payload columns of which stay with the run."""
    levels: list[DataFrame] = []
    roots = []
    payload = [c for c in nodes.columns if c not in ("tree", "pos", "size", "hash")]
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        runs = (
            nodes.where("size > 1")
            .groupBy("tree", "size", F.floor(F.col("pos") / ARITY).alias("run"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "hash", *payload))).alias("members"))
        )
        runs = written(runs.withColumn("level", F.lit(len(levels)).cast("bigint")), "merkle-runs")
        roots.append(nodes.where("size = 1").select("tree", "hash"))
        levels.append(runs)
        nodes, payload = (
            runs.select(
                "tree",
                F.col("run").alias("pos"),
                F.ceil(F.col("size") / ARITY).alias("size"),
                digest(F.concat_ws("", F.col("members.hash"))).alias("hash"),
            ),
            [],
        )
        most = -(-most // ARITY)
    roots.append(nodes.select("tree", "hash"))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionAll(more)
    return Forest(levels, found, len(levels))


def _steps(runs: DataFrame, payload: list[str]) -> DataFrame:
    """For each member of each run the way to its parent: a segment of one level."""
    at = F.col("at")
    others = F.filter("members", lambda x: x["pos"] != F.col("member.pos"))
    siblings = F.unhex(F.array_join(F.transform(others, lambda x: x["hash"]), ""))
    last = F.ceil(F.col("size") / ARITY) == 1
    inner = F.col("tree") != TOP
    return runs.select("*", F.posexplode("members").alias("at", "member")).select(
        "tree",
        "level",
        F.col("member.pos").alias("pos"),
        # The root of a language's tree is a leaf of the top one.
        F.when(inner & last, F.lit(TOP)).otherwise(F.col("tree")).cast("bigint").alias("up_tree"),
        F.when(inner & last, F.lit(0)).otherwise(F.col("level") + 1).cast("bigint").alias("up_level"),
        F.when(inner & last, F.col("tree")).otherwise(F.col("run")).cast("bigint").alias("up_pos"),
        F.array(F.struct(at.cast("tinyint").alias("at"), siblings.alias("siblings"))).alias("path"),
        *[F.col(f"member.{name}").alias(name) for name in payload],
    )


KEY = ("tree", "level", "pos")
UP = ("up_tree", "up_level", "up_pos")


def _jumped(rows: DataFrame, nodes: DataFrame, distance: int) -> DataFrame:
    """Rows whose path of ``distance`` levels goes on with that of the ancestor it leads to."""
    # Nothing in a language's tree below this level is so far above anything.
    able = nodes.where((F.col("level") >= distance) | (F.col("tree") == TOP)).select(
        *[F.col(k).alias(f"at_{u}") for k, u in zip(KEY, UP)],
        *[F.col(u).alias(f"to_{u}") for u in UP],
        F.col("path").alias("more"),
    )
    joined = rows.join(
        small(able, able.count() * LEVEL_WEIGHT * distance),
        [F.col(u) == F.col(f"at_{u}") for u in UP],
        "left",
    )
    path = F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more"))
    return joined.select(
        *[c for c in rows.columns if c not in (*UP, "path")],
        *[F.col(f"to_{u}").alias(u) for u in UP],
        path.alias("path"),
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""

    def up(node: Column, step: Column) -> Column:
        siblings = F.lower(F.hex(step["siblings"]))
        before = step["at"].cast("int") * 64
        return digest(
            F.concat(
                F.substr(siblings, F.lit(1), before), node, F.substr(siblings, before + F.lit(1))
            )
        )

    return F.aggregate(path, leaf, up)


def proofs(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, leaf, the leaf ``shown`` after tampering, subroot, root and path: for each
    level up to the root its place among the siblings, and their digests from left to right."""
    table = ranked(written(leaves(docs), "merkle-leaves"), "group", ["doc_id", "leaf"])
    by_group = written(table.where("pos = 0").select("group"), "merkle-groups")
    groups = ranked(by_group.withColumn("all", F.lit(0)), "all", ["group"]).select(
        "group", F.col("pos").alias("tree")
    )
    groups = written(groups, "merkle-trees")
    payload = ["doc_id", "leaf", "shown"]
    table = table.join(small(groups, groups.count()), "group").select(
        "tree", "pos", "size", F.col("leaf").alias("hash"), *payload
    )
    table = written(table, "merkle-placed")
    trees = forest(table)
    subroots = written(trees.roots.withColumnRenamed("hash", "subroot"), "merkle-subroots")
    n_trees = subroots.count()
    top = forest(
        subroots.select(
            F.lit(TOP).cast("bigint").alias("tree"),
            F.col("tree").alias("pos"),
            F.lit(n_trees).cast("bigint").alias("size"),
            F.col("subroot").alias("hash"),
        )
    )
    root = next((row["hash"] for row in top.roots.take(1)), None)

    # A leaf that is alone in its language is a leaf of the top tree, at distance 0.
    rows = table.where("size = 1").select(
        "tree",
        F.lit(TOP).cast("bigint").alias("up_tree"),
        F.lit(0).cast("bigint").alias("up_level"),
        F.col("tree").alias("up_pos"),
        F.expr("cast(array() as array<struct<at:tinyint,siblings:binary>>)").alias("path"),
        *payload,
    )
    if trees.levels:
        rows = rows.unionByName(_steps(trees.levels[0], payload).drop("level", "pos"))
    inner = [_steps(runs, []) for runs in [*trees.levels[1:], *top.levels]]
    if inner:
        nodes = inner[0]
        for more in inner[1:]:
            nodes = nodes.unionAll(more)
        nodes, rows = written(nodes, "merkle-nodes"), written(rows, "merkle-paths")
        # A lone leaf starts one level behind the others.
        behind = 1 if table.where("size = 1").take(1) else 0
        distance, height = 1, trees.height + top.height
        while True:
            rows = _jumped(rows, nodes, distance)
            distance *= 2
            if distance >= height + behind:
                break
            rows = written(rows, "merkle-paths")
            nodes = written(_jumped(nodes, nodes, distance // 2), "merkle-nodes")
    return rows.join(small(subroots, n_trees), "tree").select(
        *payload, "subroot", F.lit(root).alias("root"), "path"
    )


def verified(docs: DataFrame) -> DataFrame:
    """Every row's proof and what it says of the row after tampering."""
    siblings = F.array_join(F.transform("path", lambda x: F.lower(F.hex(x["siblings"]))), "")
    return (
        proofs(docs)
        .withColumn("folded_root", folded(F.col("shown"), F.col("path")))
        .select(
            "doc_id",
            "leaf",
            "subroot",
            "root",
            digest(siblings).alias("proof_sha256"),
            "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
            "path",
        )
    )
