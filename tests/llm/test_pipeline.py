from collections import Counter

import pytest

import corpus_pipeline
from fieldtempo.llm import mixing
from fieldtempo.llm.entries import documents, queries
from fieldtempo.llm.storage import written
from tests.llm import frames
from tests.llm.test_simhash_anchors import smallest_ids
from tests.llm.test_suffix_pieces import LIBRARY

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = documents(spark, FOLDER)
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(written(stage(spark, found[-1], FOLDER), "test"))
    return [frame.collect() for frame in found]


def test_toxic_documents_go_and_others_stay(spark, stages):
    predicted = {r["doc_id"]: r["predicted"] for r in queries()["op3_toxicity"](spark, FOLDER).collect()}
    kept = [r["doc_id"] for r in stages[1]]
    assert sorted(kept) == sorted(i for i, toxic in predicted.items() if not toxic)
    assert 0 < len(kept) < len(stages[0])


def test_exact_copies_leave_the_largest_id(stages):
    largest = {}
    for r in stages[1]:
        largest[r["text"]] = max(r["doc_id"], largest.get(r["text"], -1))
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(largest.values())
    assert len(stages[2]) < len(stages[1])
    assert {tuple(r) for r in stages[2]} <= {tuple(r) for r in stages[0]}


def test_near_copies_leave_one_of_each_group(stages):
    expected = {c for _, _, c in smallest_ids([(r["doc_id"], r["text"]) for r in stages[2]])}
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(expected)


def test_mixing_repeats_as_the_targets_ask(stages):
    def size(r):
        return len(r["text"].encode().split())

    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in stages[3]:
        sizes[r["source"]] += size(r)
        largest[r["source"]] = max(size(r), largest[r["source"]])
    for r in stages[4]:
        taken[r["source"]] += size(r)
    assert max(Counter(r["doc_id"] for r in stages[4]).values()) <= 2
    order = sorted(sizes)
    weights = [mixing.WEIGHTS[n % 3] for n in range(len(order))]
    targets = mixing.water_fill([sizes[s] for s in order], weights, 1.5 * sum(sizes.values()), 2.0)
    for source, target in zip(order, targets):
        assert abs(taken[source] - target) <= largest[source]


def test_ids_are_those_of_the_library(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert Counter(r["doc_id"] for r in stages[5]) == Counter(r["doc_id"] for r in stages[4])
    for r in stages[5]:
        assert r["ids"] == LIBRARY.encode(texts[r["doc_id"]])


def test_run_gives_the_rows_of_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter(
        (r["doc_id"], tuple(r["ids"])) for r in stages[5]
    )
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("make", [frames.awkward, frames.empty])
def test_stages_carry_awkward_tables(spark, make):
    docs = make(spark)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, FOLDER), "test")
        assert docs.columns == columns
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() > 0) == (make is frames.awkward)
