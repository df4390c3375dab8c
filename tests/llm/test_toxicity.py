import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldtempo.llm import toxicity
from fieldtempo.llm.entries import queries
from tests.llm import frames

INSULTS = ["vilething", "badthing", "cursed"]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def table(n=300):
    rows, marks = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"w{chr(97 + (i * k) % 26)}{chr(97 + k)}" for k in range(1, 15)]
        rows.append((i, " ".join(words + ([INSULTS[i % 3]] * 2 if toxic else []))))
        marks.append((i, 1, int(toxic)))
    return rows, marks


def cosine(index, a, b):
    x, y = (dict(zip(*map(np.ndarray.tolist, index.vector(v, index.weight)))) for v in (a, b))
    return sum(x[k] * y.get(k, 0.0) for k in x)


@settings(max_examples=40, deadline=None)
@given(
    st.lists(st.sets(st.integers(0, 11), min_size=1), min_size=1, max_size=200),
    st.sets(st.integers(0, 11), min_size=1),
)
def test_block_max_search_finds_the_exact_nearest(examples, query):
    df = [sum(n in e for e in examples) for n in range(12)]
    index = toxicity.BlockMaxIndex.build(
        {f"f{n}": n for n in range(12)},
        df,
        len(examples),
        [(i, i % 2, list(e)) for i, e in enumerate(examples)],
        {0: 1, 1: 1},
        {0: 1, 1: 1},
    )
    best, scores = index.nearest(list(query), k=5)
    of = dict(enumerate(examples))
    expected = sorted((cosine(index, list(query), list(of[i])) for i in of), reverse=True)
    expected = [x for x in expected if x > 0][:5]
    assert scores.tolist() == pytest.approx(expected)
    assert [cosine(index, list(query), list(of[index.ids[n]])) for n in best] == pytest.approx(
        scores.tolist()
    )


def test_planted_toxic_documents_are_found_and_clean_ones_left(spark):
    rows, marks = table()
    docs = frames.documents(spark, rows)
    result = toxicity.score_texts(docs, toxicity.fit(docs, frames.labels(spark, marks))).collect()
    toxic = {i: t for i, _, t in marks}
    assert len(result) == len(rows)
    for r in result:
        assert r["held_out"] == held_out(r["doc_id"])
        assert r["predicted"] == toxic[r["doc_id"]] == int(r["score"] >= 0.5)
        assert 0 <= r["score"] <= 1
    evidence = [e for r in result if r["predicted"] for e in r["evidence"]]
    assert evidence and all(e["toxic"] == toxic[e["doc_id"]] for e in evidence)
    assert not any(held_out(e["doc_id"]) for e in evidence)


def test_a_copy_of_a_toxic_example_with_rare_words_is_found(spark):
    rows, marks = table()
    rare = "qumblor zvethnik draxopil yeomfarst quixbent " + rows[1][1]
    example = next(i for i in range(1000, 1100) if not held_out(i))
    copy = next(i for i in range(2000, 2100) if held_out(i))
    docs = frames.documents(spark, [*rows, (example, rare), (copy, rare)])
    index = toxicity.fit(docs, frames.labels(spark, [*marks, (example, 1, 1)]))
    found = {r["doc_id"]: r for r in toxicity.score_texts(docs, index).collect()}
    assert found[copy]["predicted"] == 1
    nearest = found[copy]["evidence"][0]
    assert nearest["doc_id"] == example and nearest["similarity"] == pytest.approx(1)
    assert found[1]["predicted"] == 0
    assert {"qumbl", "draxo"} <= index.vocabulary.keys()


def test_document_frequencies_cover_all_documents(spark):
    texts = ["abc abc xyz", "abc unseen", "", None, "unseen"]
    docs = frames.documents(spark, list(enumerate(texts)))
    df, total = toxicity.document_frequencies(docs, {"abc": 0, "xyz": 1})
    assert (df.tolist(), total) == ([2, 1], 3)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows, marks = table()
    docs = frames.documents(spark, rows)
    turned = [(i, q, 1 - t if held_out(i) else t) for i, q, t in marks]
    scores = [
        sorted(
            (r["doc_id"], r["score"])
            for r in toxicity.score_texts(docs, toxicity.fit(docs, frames.labels(spark, m))).collect()
        )
        for m in (marks, turned)
    ]
    assert scores[0] == scores[1]


def test_awkward_rows_and_missing_labels(spark):
    docs = frames.awkward(spark)
    marks = [(1, 1, 1), (4, 1, 0), (4, 1, 0), (6, None, None), (None, 1, 1), (777, 0, 1)]
    for some in (marks, []):
        index = toxicity.fit(docs, frames.labels(spark, some))
        result = toxicity.score_texts(docs, index).collect()
        assert len(result) == len(frames.AWKWARD)
        assert all(0 <= r["score"] <= 1 for r in result)
        kept = toxicity.without_toxic(docs, index)
        assert kept.columns == docs.columns
        assert kept.count() == sum(1 - r["predicted"] for r in result)
    assert not any(r["score"] for r in result)
    none = frames.empty(spark)
    assert toxicity.score_texts(none, toxicity.fit(none, frames.labels(spark))).count() == 0


def test_search_leaves_blocks_out(spark):
    rows, marks = table(2600)
    index = toxicity.fit(frames.documents(spark, rows), frames.labels(spark, marks))
    n_blocks = -(-len(index.labels) // toxicity.BLOCK)
    scored = [
        index.searched(toxicity.numbered(text, index.vocabulary)[0])[2] / n_blocks for _, text in rows[:400]
    ]
    assert n_blocks > 30 and sum(scored) / len(scored) < 0.6


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    rows, marks = table()
    # Ids with several texts, and labelled both ways.
    rows += [(i, f"another text of {i} cursed") for i in range(0, 300, 7)]
    marks += [(i, 1, 1 - i % 2) for i in range(0, 300, 11)]
    results = []
    for parts in (1, 7):
        docs = frames.documents(spark, rows).repartition(parts, "text")
        index = toxicity.fit(docs, frames.labels(spark, marks).repartition(parts))
        found = toxicity.score_texts(docs.select("doc_id", "text"), index).collect()
        results.append(sorted((r["doc_id"], r["score"], str(r["evidence"])) for r in found))
    assert results[0] == results[1]


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CLASS_BYTES", 5_000)
    monkeypatch.setattr(toxicity, "EXAMPLE_BYTES", 1_000)
    rows = [(i, f"word{i % 50} " * (20 if i % 10 else 2000)) for i in range(1000)]
    marks = [(i, 1, i % 2) for i in range(1000)]
    sample, sizes = toxicity.labelled(frames.documents(spark, rows), frames.labels(spark, marks))
    texts = sample.collect()
    for label in (0, 1):
        size = [len(r["text"]) for r in texts if r["toxic"] == label]
        assert 0 < sum(size) <= 5_000 and max(size) <= 1_000 and len(size) > 20
    assert sum(sizes.values()) == sum(not held_out(i) for i in range(1000))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    predicted = {r["doc_id"]: r for r in queries()["op3_toxicity"](spark, folder).collect()}
    found = Counter()
    errors = []
    for row in spark.read.parquet(f"{folder}/labels.parquet").collect():
        r = predicted[row["doc_id"]]
        if r["held_out"]:
            found[row["toxic"], r["predicted"]] += 1
            errors.append((r["score"] - row["toxic"]) ** 2)
    assert found[1, 1] / (found[1, 1] + found[1, 0]) > 0.8
    assert found[0, 1] / (found[0, 1] + found[0, 0]) < 0.02
    assert math.isclose(sum(found.values()), 825, abs_tol=60)
    # The scores are near the labels on the whole, not only on the right side of a half.
    assert sum(errors) / len(errors) < 0.02
