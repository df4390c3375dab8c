import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fieldtempo.llm import merkle_manifest as mm
from tests.llm import frames


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def runs(nodes):
    return [nodes[i : i + 8] for i in range(0, len(nodes), 8)]


def climb(place, levels):
    """The siblings of each level, before and after, and the place above."""
    for nodes in levels:
        run = runs(nodes)[place // 8]
        yield run[: place % 8], run[place % 8 + 1 :]
        place //= 8


def tree(nodes):
    """The levels that have more than one node, and the root."""
    levels = []
    while len(nodes) > 1:
        levels.append(nodes)
        nodes = [h("".join(run)) for run in runs(nodes)]
    return levels, nodes[0]


def brute_force(rows):
    full = [(*row, *[None] * (5 - len(row))) for row in rows]
    langs = sorted({row[2] for row in full}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(
            (row for row in full if row[2] == lang),
            key=lambda row: (row[0] is not None, row[0] or 0, leaf(row)),
        )
        trees[lang] = (own, *tree([leaf(row) for row in own]))
    top, root = tree([trees[lang][2] for lang in langs])
    for n, lang in enumerate(langs):
        own, levels, subroot = trees[lang]
        for place, row in enumerate(own):
            steps = [*climb(place, levels), *climb(n, top)]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = leaf(row, lower=tampered)
            for before, after in steps:
                node = h("".join([*before, node, *after]))
            proof = h("".join("".join(before + after) for before, after in steps))
            yield (row[0], leaf(row), subroot, root, proof, node, node == root)


CASES = {
    "awkward": frames.AWKWARD,
    "one": [(7, "Only One", "en")],
    "lone languages": [(n, f"Text {n}", f"l{n:02}") for n in range(20)],
    "one large and lone ones": [
        *[(n, f"Text {n}", "en", "s", n) for n in range(150)],
        *[(500 + n, f"Other {n}", f"l{n:02}") for n in range(9)],
    ],
    "nine levels of nothing": [(n, "Same Text", None) for n in range(9)],
    "repeated": [(5, "Same Text", "en")] * 70 + [(None, "Same Text", "en")] * 70,
    "negative": [(-n, f"Text {n}", "en") for n in range(65)],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_proofs_match_brute_force(spark, case):
    docs = frames.with_clashing_columns(frames.documents(spark, CASES[case]))
    result = mm.verified(docs).drop("path").collect()
    assert sorted(map(tuple, result), key=repr) == sorted(brute_force(CASES[case]), key=repr)


def test_paths_lead_to_the_root_only_from_the_true_leaf(spark):
    docs = frames.documents(spark, CASES["one large and lone ones"])
    rows = mm.proofs(docs)
    again = rows.withColumn("again", mm.folded(F.col("leaf"), F.col("path"))).collect()
    assert all(r["again"] == r["root"] for r in again)
    other = rows.withColumn("again", mm.folded(F.lit(h("x")), F.col("path"))).collect()
    assert all(r["again"] != r["root"] for r in other)
    # The longest path: three levels of one language, two of the top tree.
    assert {len(r["path"]) for r in again} == {2, 5}


def test_equal_rows_are_spread_when_ranked(spark, monkeypatch):
    monkeypatch.setattr(mm, "SORT_ROWS", 100)
    rows = mm.written(mm.leaves(frames.documents(spark, [(5, "same", "en")] * 4000)), "ranked")
    ranked = mm.ranked(rows, "group", ["doc_id", "leaf"])
    assert sorted(r["pos"] for r in ranked.collect()) == list(range(4000))
    assert {r["size"] for r in ranked.collect()} == {4000}
    per_task = ranked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 2000


def test_an_empty_table_stays_empty(spark):
    result = mm.verified(frames.empty(spark))
    assert result.count() == 0
    assert result.columns[:7] == [
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified",
    ]
