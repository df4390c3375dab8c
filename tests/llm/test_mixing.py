from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from fieldtempo.llm import mixing
from fieldtempo.llm.entries import queries
from tests.llm import frames


@given(
    st.lists(st.integers(0, 1000), min_size=1, max_size=12),
    st.floats(0.1, 1.9),
)
def test_water_fill(sizes, share):
    weights = [mixing.WEIGHTS[n % 3] for n in range(len(sizes))]
    targets = mixing.water_fill(sizes, weights, share * sum(sizes), 2.0)
    assert sum(targets) == pytest.approx(share * sum(sizes))
    assert all(t <= 2 * size + 1e-9 for t, size in zip(targets, sizes))
    # Sources below their cap have one level by weight; those at it would be above.
    levels = [t / w for t, w, s in zip(targets, weights, sizes) if t < 2 * s - 1e-6]
    assert max(levels, default=0) == pytest.approx(min(levels, default=0))
    capped = [2 * s / w for t, w, s in zip(targets, weights, sizes) if s and t >= 2 * s - 1e-6]
    assert not levels or all(x <= max(levels) + 1e-6 for x in capped)


def rows():
    found = [(i, "word " * (1 + i % 40), None, f"s{i % 5}") for i in range(1500)]
    found += [(5000 + i, "hot words here", None, "hot") for i in range(1500)]
    return [*found, (9000, None, None, None), (9001, "three more words", None, None)]


def test_sources_come_near_their_targets(spark):
    docs = frames.documents(spark, rows())
    result = mixing.mix(docs).collect()
    assert len(result) == len(rows())
    source = {row[0]: row[3] for row in rows()}
    taken, targets, largest = defaultdict(int), {}, defaultdict(int)
    for r in result:
        taken[source[r["doc_id"]]] += r["taken"]
        targets[source[r["doc_id"]]] = r["target"]
        largest[source[r["doc_id"]]] = max(largest[source[r["doc_id"]]], r["size"])
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in targets)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(r["size"] for r in result))
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, result))


def test_mixed_documents_repeat_as_often_as_the_mix_says(spark):
    docs = frames.with_clashing_columns(frames.documents(spark, rows()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for r in mixing.mix(docs).collect():
        if r["size"]:
            assert times.get(r["doc_id"], 0) * r["size"] == r["taken"]


def test_awkward_and_empty_tables(spark):
    result = mixing.mix(frames.awkward(spark)).collect()
    assert len(result) == len(frames.AWKWARD)
    assert all(r["taken"] <= 2 * r["size"] for r in result)
    mixing.mixed_documents(frames.awkward(spark)).collect()
    assert mixing.mix(frames.empty(spark)).count() == 0
    assert mixing.mixed_documents(frames.empty(spark)).count() == 0


def test_query_counts_whole_texts(spark):
    folder = "/root/testdata/sf0.001"
    result = queries()["op10_mixing"](spark, folder).collect()
    words = {
        r["doc_id"]: len((r["text"] or "").encode().split())
        for r in spark.read.parquet(f"{folder}/documents.parquet").collect()
    }
    assert {r["doc_id"]: r["size"] for r in result} == words


def repeated_rows():
    """Repeated rows are two fifths of all, and the ids of some texts are null."""
    rows = [(i, f"text {i} of ten words in all so it is", "en", "s") for i in range(600)]
    return rows + [(77, "text 77 of ten words in all so it is", "en", "s")] * 400


def brute_force(digest, plan):
    """Words taken by source: all rows by hash and order, each taken while that comes nearer."""
    taken = defaultdict(list)
    for source, (whole, quota) in plan.items():
        left = quota
        own = sorted((r for r in digest if r["source"] == source), key=lambda r: (r["hash"], r["order"]))
        for r in own:
            more = int(r["size"] > 0 and left > 0 and 2 * left >= r["size"])
            left -= r["size"]
            taken[source].append((r["doc_id"], r["size"], r["size"] * min(2, whole + more)))
    return taken


@pytest.mark.parametrize("seed", [20, 21, 22, 23])
def test_taken_matches_brute_force_where_rows_repeat(spark, seed):
    rows = repeated_rows()
    docs = frames.documents(spark, rows).repartition(5)
    digest = mixing.written(mixing._digest(docs, seed), "test").collect()
    total = sum(r["size"] for r in digest)
    target = mixing.water_fill([total], [3.0], 1.5 * total, 2.0)[0]
    expected = brute_force(digest, {"s": (int(target // total), target - target // total * total)})
    result = mixing.mix(docs, seed=seed).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in result) == sorted(expected["s"])
    assert abs(sum(r["taken"] for r in result) - target) <= max(r["size"] for r in result) / 2
    mixed = mixing.mixed_documents(frames.with_clashing_columns(docs), seed=seed)
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    words = defaultdict(int)
    for r in result:
        words[r["doc_id"]] += r["taken"]
    assert {i: n * 10 for i, n in times.items()} == {i: n for i, n in words.items() if n}


def test_taken_matches_brute_force_on_many_sources(spark):
    digest = mixing.written(mixing._digest(frames.documents(spark, rows()), mixing.SEED), "test").collect()
    targets = {s: (n, t) for s, n, t in mixing.source_targets(
        spark.createDataFrame([(r["source"], r["size"]) for r in digest], "source string, size bigint"), 1.5, 2.0
    )}
    plan = {s: (int(t // n), t - t // n * n) for s, (n, t) in targets.items() if n}
    expected = sorted(x for found in brute_force(digest, plan).values() for x in found)
    result = mixing.mix(frames.documents(spark, rows())).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in result if r["source_size"]) == expected


def test_a_group_of_repeated_rows_is_counted_off_by_many_tasks(spark):
    docs = frames.documents(spark, [(7, "one two three", "en", "s")] * 3000).repartition(8)
    result = mixing.mix(docs)
    assert result.agg({"taken": "sum"}).first()[0] == 13_500
    edge = mixing.written(
        mixing._digest(docs, 1).withColumns({"rest": mixing.F.lit(1500.0)}), "test"
    )
    dealt = mixing._dealt(edge, ("source", "order", "size", "rest", "row", "more"))
    by_task = dealt.groupBy(mixing.F.shiftright("row", 33)).agg({"more": "sum"}).collect()
    assert len(by_task) > 4 and sum(r[1] for r in by_task) == 500
