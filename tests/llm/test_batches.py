import weakref

import pyarrow as pa
import pytest

from fieldtempo.llm import grace_dedup, mixing, toxicity
from fieldtempo.llm.batches import parts, releasing
from tests.llm import frames


def rows(texts, first=0):
    names = ["doc_id", "text", "hash", "n", "placed"]
    ids = range(first, first + len(texts))
    columns = [ids, texts, [hash(t or "") for t in texts], [1] * len(texts), [True] * len(texts)]
    return pa.RecordBatch.from_pydict(dict(zip(names, map(list, columns))))


def copies(text, n):
    """Equal strings, each with memory of its own."""
    return ["".join([text[:1], text[1:]]) for _ in range(n)]


def test_parts_have_all_rows_and_few_bytes():
    batch = rows(["a" * 40, None, "é" * 30, "", "b" * 500, "c"])
    found = list(parts(batch, 1, 100))
    assert [x.column(0).to_pylist() for x in found] == [[0, 1, 2, 3], [4], [5]]
    assert list(parts(batch.slice(0, 0), 1, 100)) == []


def test_a_task_gives_back_what_arrow_kept(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            self.released += 1

    pool = Pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    run = releasing(lambda batches: (x.slice(1) for x in batches))
    assert [x.num_rows for x in run(iter([rows(["a", "b"]), rows(["c"])]))] == [1, 0]
    assert pool.released == 1


@pytest.mark.parametrize("combine", [True, False])
def test_a_table_holds_the_text_of_a_group_once(monkeypatch, combine):
    tables = []

    class Table(grace_dedup.ContentTable):
        def __init__(self):
            super().__init__()
            tables.append(self)

    monkeypatch.setattr(grace_dedup, "ContentTable", Table)
    run = grace_dedup._task(1, 0, 2, 1 << 20, combine, True)
    found = [r for b in run(iter([rows(copies("some text", 5)), rows(copies("other", 3), 5)])) for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["text"], r["n"]) for r in found) == [(4, "some text", 5), (7, "other", 3)]
    (table,) = tables
    assert [row[1] for row in table.rows] == ["some text", "other"]
    assert all(row[1] is content for row, content in zip(table.rows, table.contents))


def test_a_table_counts_the_memory_of_wide_texts():
    # One wide character makes each character of a text take four bytes.
    texts = [f"{n}\U0001f600" + "a" * 1000 for n in range(20)]
    run = grace_dedup._task(1, 0, 2, 10 * (4 * 1000 + grace_dedup.RECORD_BYTES), False, True)
    found = [r for b in run(iter([rows(texts)])) for r in b.to_pylist()]
    assert sorted(r["text"] for r in found) == sorted(texts)
    assert 1 <= sum(r["placed"] for r in found) <= 10


def test_a_task_lets_go_of_its_first_batch():
    held = []

    def batches():
        for n in range(3):
            batch = rows(copies(f"text {n}", 2), 2 * n)
            held.append(weakref.ref(batch))
            yield batch
            del batch
            if n:
                assert held[0]() is None

    run = grace_dedup._task(1, 0, 2, 1 << 20, True, True)
    assert sum(b.num_rows for b in run(batches())) == 3


def test_scores_are_remembered_without_evidence():
    examples = [(1, 1, [0, 1]), (2, 0, [2])]
    index = toxicity.BlockMaxIndex.build({"bad": 0, "words": 1, "good": 2}, [1, 1, 1], 2, examples, {0: 1, 1: 1}, {0: 1, 1: 1})
    whole, bare = index.scorer(), index.scorer(evidence=False)
    for text in ("bad words", "good", "", None, "bad words"):
        assert bare(text) == (whole(text)[0], [])
    assert whole("bad words")[1]


def test_a_mixing_plan_starts_no_python_workers(spark, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("rows went through Python workers")

    docs = frames.documents(spark, [(1, "a b", "en", None), (2, "c", "en", "x"), (3, None, "en", "y")])
    digest = mixing._digest(docs, mixing.SEED)
    empty = digest.where("false")
    monkeypatch.setattr(spark.sparkContext, "parallelize", refuse)
    plan, sources = mixing.mixing_plan(digest)
    found = {r["source"]: (r["source_size"], r["target"]) for r in plan.collect()}
    assert found == {"x": (1, 2.0), "y": (0, 0.0), None: (2, 2.5)} and sources == 3
    plan, sources = mixing.mixing_plan(empty)
    assert plan.collect() == [] and sources == 0
