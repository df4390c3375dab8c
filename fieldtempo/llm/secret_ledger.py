"""Secret scans over an incremental ledger of content-addressed blobs.

Every historical version of a path is addressed by the SHA-256 of its text. A ledger holds, for each
(blob, rule, rule version) that was ever scanned, the spans found. A new commit scans only the pairs
the ledger lacks; findings go back to every path that holds the blob by a join.

Spans are 0-based code points, end exclusive. Null text counts as empty text. Copies, repeated rows
and null paths share one blob; an empty table gives an empty ledger. Only columns named by the
caller are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtempo.llm.storage import written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed by the contract of the query.
RULES = (
    Rule(
        "assign",
        1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    # A run of one class is matched to its end, so the least length can stand in the pattern.
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)

LEDGER = (
    "blob string, rule string, rule_version int, "
    "spans array<struct<start:bigint,`end`:bigint>>"
)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.range(0).selectExpr(
        "cast(null as string) AS blob",
        "cast(null as string) AS rule",
        "cast(null as int) AS rule_version",
        "cast(null as array<struct<start:bigint,`end`:bigint>>) AS spans",
    )


def address(text: Column) -> Column:
    """The content address of a text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _scan(text: Column, rule: Rule) -> Column:
    """The matches of a rule as structs of gap before, length, and length of the tested group.

    The text between two matches is what a split by the same pattern leaves, so lengths alone give
    the positions.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(
        F.zip_with(
            gaps,
            whole,
            lambda gap, match: F.struct(
                F.char_length(gap).alias("gap"), F.char_length(match).alias("size")
            ),
        ),
        tested,
        lambda pair, group: F.struct(
            pair["gap"].alias("gap"),
            pair["size"].alias("size"),
            F.char_length(group).alias("tested"),
        ),
    )
    # A split leaves one piece more than there are matches: the rest of the text.
    found = F.filter(lengths, lambda match: match["size"].isNotNull())
    possible = F.exists(whole, lambda match: F.char_length(match) >= rule.least)
    return F.when(possible, found)


def scan_unseen(
    versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text"
) -> DataFrame:
    """Ledger rows for every (blob, rule version) of the versions that the ledger lacks.

    Copies collapse on the map side, so a blob with any number of paths is sent once a task and
    scanned once. A pair without a finding gives a row too, with no spans: it was scanned.
    """
    blobs = (
        versions.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
        .withColumn("blob", address(F.col("text")))
        .groupBy("blob")
        .agg(F.first("text").alias("text"))
    )
    known = ledger.groupBy("blob").agg(
        F.collect_set(F.concat_ws("@", "rule", F.col("rule_version").cast("string"))).alias("known")
    )
    due = blobs.join(known, "blob", "left").select(
        "blob",
        "text",
        F.array_except(
            F.array(*[F.lit(rule.key) for rule in rules]),
            F.coalesce(F.col("known"), F.array().cast("array<string>")),
        ).alias("due"),
    )
    scanned = due.where(F.size("due") > 0).select(
        "blob",
        F.array(
            *[
                F.struct(
                    F.lit(rule.kind).alias("rule"),
                    F.lit(rule.version).alias("rule_version"),
                    F.lit(rule.least).alias("least"),
                    F.array_contains("due", rule.key).alias("due"),
                    F.when(
                        F.array_contains("due", rule.key), _scan(F.col("text"), rule)
                    ).alias("found"),
                )
                for rule in rules
            ]
        ).alias("scans"),
    )
    pair = ["blob", "rule", "rule_version"]
    scans = scanned.select("blob", F.inline("scans")).where("due")
    matches = scans.select(*pair, "least", F.posexplode_outer("found").alias("n", "match"))
    # One text's matches at a time, already together on the executor that scanned the blob.
    running = Window.partitionBy(*pair).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ends = matches.select(
        *pair,
        F.sum(F.col("match.gap") + F.col("match.size")).over(running).alias("end"),
        F.col("match.size").alias("size"),
        (F.col("match.tested") >= F.col("least")).alias("holds"),
    )
    span = F.struct((F.col("end") - F.col("size")).alias("start"), F.col("end"))
    return ends.groupBy(*pair).agg(
        F.array_sort(F.collect_list(F.when(F.col("holds"), span))).alias("spans")
    )


def findings_by_path(
    versions: DataFrame,
    ledger: DataFrame,
    path: str = "doc_id",
    text: str = "text",
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """For every version: its path, its blob, and ``found``, all spans by the given rules as structs
    of start, place of the kind in ``rules``, kind and end, in that order."""
    place = F.create_map(*[F.lit(x) for i, rule in enumerate(rules) for x in (rule.key, i)])
    key = F.concat_ws("@", "rule", F.col("rule_version").cast("string"))
    found = (
        ledger.where(key.isin([rule.key for rule in rules]) & (F.size("spans") > 0))
        .select("blob", "rule", place[key].alias("place"), F.explode("spans").alias("span"))
        .groupBy("blob")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("span.start").alias("start"),
                        F.col("place"),
                        F.col("rule").alias("kind"),
                        F.col("span.end").alias("end"),
                    )
                )
            ).alias("found")
        )
    )
    # A table of its own: both sides of the join are then shuffles of their own, and Spark can split
    # the paths of a blob that very many of them share.
    found = written(found, "findings")
    paths = versions.select(F.col(path).alias("path"), address(F.col(text)).alias("blob"))
    return paths.join(found, "blob", "left").select(
        "path",
        "blob",
        F.coalesce(
            "found",
            F.array().cast("array<struct<start:bigint,place:int,kind:string,`end`:bigint>>"),
        ).alias("found"),
    )
