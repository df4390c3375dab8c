import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from fieldtempo.llm import components, simhash_anchors
from fieldtempo.llm.entries import documents, queries
from tests.llm import frames


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or (
        [" ".join(words)] if words else []
    )
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, distance=3):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    for a, b in combinations(sorted(points), 2):
        if (a ^ b).bit_count() <= distance:
            root[find(b)] = find(a)
    return {p: find(p) for p in points}


def smallest_ids(rows):
    points = {}
    for i, text in rows:
        points.setdefault(brute_fingerprint(text), []).append(i)
    root = brute_components(points)
    least = {}
    for p, ids in points.items():
        known = [i for i in [*ids, least.get(root[p])] if i is not None]
        least[root[p]] = min(known, default=None)
    return [(i, f"{brute_fingerprint(t):016x}", least[root[brute_fingerprint(t)]]) for i, t in rows]


def flipped(rnd, point, n):
    for bit in rnd.sample(range(64), n):
        point ^= 1 << bit
    return point


@pytest.mark.parametrize("home_points", [8192, 8])
@pytest.mark.parametrize("distance", [0, 1, 3, 5])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, home_points, distance):
    monkeypatch.setattr(simhash_anchors, "HOME_POINTS", home_points)
    rnd = random.Random(distance)
    points = {rnd.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for p in list(points)[:30]:
        for n in range(1, 7):
            points.add(flipped(rnd, p, n))
    center = rnd.getrandbits(64)
    # One group of very near points, most with the same home in one part.
    points |= {center ^ (1 << a) ^ (1 << b) for a in range(40, 64) for b in range(40, 64)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in points]
    links = simhash_anchors.near_links(spark.createDataFrame(signed, "fp bigint"), distance).collect()
    found = {p: p for p in points}

    def find(p):
        while found[p] != p:
            p = found[p]
        return p

    for a, b in links:
        a, b = a % (1 << 64), b % (1 << 64)
        assert 0 < (a ^ b).bit_count() <= distance
        found[find(max(find(a), find(b)))] = min(find(a), find(b))
    expected = brute_components(points, distance)
    groups = [{}, {}]
    for p in points:
        groups[0].setdefault(find(p), set()).add(p)
        groups[1].setdefault(expected[p], set()).add(p)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))
    assert len(links) < 40 * len(points)


def test_every_point_has_a_home_within_one_bit():
    code = simhash_anchors.AnchorCode(3)
    points = np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64)
    for part in range(code.parts):
        homes = code.home(points, part)
        assert (np.bitwise_count(homes ^ code.word(points, part)) <= 1).all()
        assert not code.syndrome(homes).any()
        keys, places = code.replicas(points, part)
        assert len(keys) == len(places) <= 16 * len(points)


@pytest.mark.parametrize("text", ["", None, "A", "a b", "Ünï A\x0bb\x1cc d", "x " * 70, "\x85 É"])
def test_fingerprint(text):
    raw = None if text is None else text.encode()
    assert simhash_anchors.fingerprint(raw) == brute_fingerprint(text)


def test_query_matches_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, folder).collect()]
    found = [tuple(r) for r in queries()["op7_simhash"](spark, folder).collect()]
    assert sorted(found) == sorted(smallest_ids(rows))


def test_awkward_rows(spark):
    docs = frames.awkward(spark)
    rows = [(row[0], row[1]) for row in frames.AWKWARD]
    found = [tuple(r) for r in simhash_anchors.near_duplicates(docs).collect()]
    assert sorted(found, key=repr) == sorted(smallest_ids(rows), key=repr)
    kept = simhash_anchors.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(
        {c for _, _, c in smallest_ids(rows)}, key=repr
    )
    assert simhash_anchors.near_duplicates(frames.empty(spark)).count() == 0
    assert simhash_anchors.one_of_each(frames.empty(spark)).count() == 0


def test_components_of_a_long_chain_and_a_large_star(spark):
    edges = [(n, n + 1) for n in range(200)] + [(1000, n) for n in range(1001, 1400)]
    rows = components.component_roots(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    roots = {r["node"]: r["root"] for r in rows}
    assert roots == {n: 0 for n in range(1, 201)} | {n: 1000 for n in range(1001, 1400)}
