import random
from itertools import accumulate

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldtempo.llm import sharding
from fieldtempo.llm.entries import queries
from tests.llm import frames


def greedy_shards(sizes, capacity):
    shards, held = 1, 0
    for size in sizes:
        if size > capacity:
            return 1 << 60
        if held + size > capacity:
            shards, held = shards + 1, 0
        held += size
    return shards


def best_capacity(sizes, shards):
    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if greedy_shards(sizes, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def ordered_groups(rows):
    sizes = {}
    for _, text in rows:
        key = xxhash.xxh64_intdigest((text or "").encode(), 42)
        key = key - (1 << 64) if key >> 63 else key
        sizes[key] = sizes.get(key, 0) + len((text or "").encode()) + 1
    return [sizes[key] for key in sorted(sizes)]


def check(spark, rows, shards=8):
    result = sharding.minimax_shards(frames.documents(spark, rows), shards).collect()
    assert len(result) == len(rows)
    sizes, slots, of_text = [0] * shards, [[] for _ in range(shards)], {}
    texts = {}
    for i, text in rows:
        texts.setdefault(i, text)
    for r in result:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of_text.setdefault(texts[r["doc_id"]] or "", set()).add(r["shard"])
    assert all(sorted(found) == list(range(len(found))) for found in slots)
    assert all(len(found) == 1 for found in of_text.values())
    assert max(sizes) <= best_capacity(ordered_groups(rows), shards)
    return sizes


def test_the_largest_shard_is_as_small_as_can_be(spark):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choices("abcé ", k=rnd.randrange(400)))) for i in range(700)]
    sizes = check(spark, rows)
    assert max(sizes) < 1.1 * sum(sizes) / 8


def test_a_hot_group_stays_together(spark):
    rnd = random.Random(4)
    rows = [(i, f"{rnd.random()}") for i in range(400)]
    check(spark, [*rows, *[(1000 + i, "hot text") for i in range(200)]])


def test_few_groups_and_awkward_rows(spark):
    check(spark, [(1, "a"), (2, "b"), (3, None)])
    result = sharding.minimax_shards(frames.awkward(spark)).collect()
    assert len(result) == len(frames.AWKWARD)
    assert sharding.minimax_shards(frames.empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 9), st.integers())
def test_refining_ends_at_the_brute_force_capacity(sizes, shards, seed):
    rnd = random.Random(seed)
    keys = sorted({rnd.getrandbits(64) for _ in sizes})
    groups = dict(zip(keys, sizes))

    def nodes(inside, bits):
        found = {}
        for key in inside:
            found.setdefault(key >> (64 - bits), []).append(key)
        return [
            sharding.Node(prefix, bits, sum(groups[k] for k in held), held[0], held[-1])
            for prefix, held in found.items()
        ]

    current = nodes(keys, 3)
    while split := (greedy := sharding._Pass(current, shards)).open_nodes():
        current = [n for i, n in enumerate(greedy.nodes) if i not in split] + [
            child
            for i in split
            for child in nodes(
                [k for k in keys if k >> (64 - greedy.nodes[i].bits) == greedy.nodes[i].prefix],
                greedy.nodes[i].bits + 4,
            )
        ]
    capacity = greedy.smallest(late=False)
    assert capacity == best_capacity(sizes, shards)
    cuts = [greedy.nodes[n].first for n in greedy.cuts(capacity, late=False)]
    sums = [0, *accumulate(sizes)]
    edges = [0, *(keys.index(cut) for cut in cuts), len(keys)]
    assert all(sums[b] - sums[a] <= capacity for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = queries()["op8_sharding"](spark, f"/root/testdata/{sf}").collect()
    assert {r["law"] for r in rows} == {"bytes"}
    assert {r["shard"] for r in rows} == set(range(8))
    assert {r["grown_shard"] for r in rows} == {None}


def test_repeated_rows_are_numbered_by_many_tasks(spark):
    docs = frames.documents(spark, [(5, "same")] * 3000 + [(i, f"text {i}") for i in range(100)])
    numbered = sharding.minimax_shards(docs.repartition(6))
    hot = numbered.where("doc_id = 5 and size = 5").groupBy(F.spark_partition_id()).count().collect()
    assert len(hot) > 3 and max(r["count"] for r in hot) < 2000
    slots = [r["slot"] for r in numbered.where("doc_id = 5 and size = 5").collect()]
    assert len(set(slots)) == 3000
