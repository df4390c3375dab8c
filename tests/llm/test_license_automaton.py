import random
import re

import pytest

from fieldtempo.llm import license_automaton as la
from fieldtempo.llm.entries import op12_license_scans
from fieldtempo.llm.license_templates import NOTICES, PHRASES
from tests.llm import frames

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(lowered)


def base(text):
    words = split(text)
    found = []
    for label, phrase in PHRASES:
        wanted = phrase.split()
        found += [
            (n, label) for n in range(len(words) - len(wanted) + 1) if words[n : n + len(wanted)] == wanted
        ]
    return len(words), sorted(found)


def expected_base(text):
    n_words, found = base(text)
    starts = [n for n, _ in found]
    labels = ",".join(sorted({label for _, label in found}))
    return n_words, len(found), min(starts, default=None), max(starts, default=None), labels


def longest_runs(templates, words):
    """The matching statistics, by looking everywhere."""
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    return [
        next((n + 1 - i for i in range(n + 1) if tuple(words[i : n + 1]) in runs), 0)
        for n in range(len(words))
    ]


@pytest.mark.parametrize("seed", range(40))
def test_matching_statistics_and_whole_places_match_brute_force(seed):
    draw = random.Random(seed)
    templates = [[draw.choice("abc") for _ in range(draw.randint(1, 9))] for _ in range(draw.randint(1, 5))]
    phrases = [("p", " ".join(draw.choice("abc") for _ in range(draw.randint(1, 3)))) for _ in range(2)]
    index = la.LicenseIndex.build([("t", " ".join(t)) for t in templates], phrases)
    words = [draw.choice("abcx") for _ in range(60)]
    known = [*templates, *[p.split() for _, p in phrases]]
    expected = longest_runs(known, words)
    found = index.numbers(" ".join(words).encode())
    assert [length for _, length in index.matching_statistics(found.tolist())] == expected
    # Outside the stretches no run has more than one word.
    inside = [0] * len(words)
    for start, stretch in index.stretches(found):
        for n, (state, length) in enumerate(index.matching_statistics(stretch), start):
            inside[n] = length
            ends = {
                (t, j)
                for t, text in enumerate([*[p.split() for _, p in phrases], *templates])
                for j in range(length, len(text) + 1)
                if text[j - length : j] == words[n + 1 - length : n + 1]
            }
            assert {(t, p) for t, places in index.ends[state].items() for p in places} == ends
    assert all(a == b or b <= 1 for a, b in zip(inside, expected))
    _, places, _, _ = index.scan(" ".join(words).encode())
    assert sorted(places) == sorted(
        (n, p)
        for p, (_, phrase) in enumerate(phrases)
        for n in range(len(words) - len(phrase.split()) + 1)
        if words[n : n + len(phrase.split())] == phrase.split()
    )


def labels_of(text, index=la.LicenseIndex.build()):
    _, _, spans, score = index.scan(text.encode())
    return {span[0] for span in spans}, score


def test_notices_are_found_whole_and_with_changes():
    for label, text in NOTICES:
        found, score = labels_of(f"Some words before. {text} And after.")
        assert label in found and score == 1.0
        words = text.split()
        if len(words) > 30:
            changed = [w if n % 12 != 6 else "changed" for n, w in enumerate(words)]
            found, score = labels_of(" ".join(changed))
            assert label in found and la.COVERED <= score <= 1.0


def test_plain_text_has_no_label():
    text = "The terms of the contract permit the use of this room for any purpose without a fee."
    found, score = labels_of(text)
    assert found == set() and score < la.COVERED
    assert labels_of("") == (set(), 0.0)


def test_spans_tell_where_a_copy_lies_and_each_copy_counts():
    notice = dict(NOTICES)["isc"]
    index = la.LicenseIndex.build()
    text = f"one two three {notice} " + "gap " * 50 + notice
    spans = [s for s in index.scan(text.encode())[2] if s[0] == "isc"]
    n = len(split(notice))
    assert spans == [("isc", 3, 2 + n, n, n), ("isc", 53 + n, 52 + 2 * n, n, n)]


def test_chunks_cut_no_words(monkeypatch):
    monkeypatch.setattr(la, "CHUNK", 7)
    text = "All rights reserved, licensed under CC BY-NC 4.0. " * 20 + "x" * 40
    assert la.words(text) == [w.encode() for w in split(text)]


AWKWARD = [
    *frames.AWKWARD,
    (20, "CC BY cc by-nc CC\nBY", "en", "a", 1),
    (21, "GENERAL Public license; All Rights Reserved_all rights reserved", "en", "a", 1),
    (22, "cc by", "en", "a", 1),
    (23, "all rights reservéd KELVIN K İ all-rights/reserved", "en", "a", 1),
    (24, "cc" + " cc by" * 30_000, "en", "a", 1),
]


def test_awkward_rows(spark):
    docs = frames.with_clashing_columns(frames.documents(spark, AWKWARD))
    rows = la.scan(docs).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_base"], repr(r["first_word"]), repr(r["last_word"]),
                   ",".join(r["base_labels"])) for r in rows) == sorted(
        (repr(row[0]), *(repr(x) if n in (2, 3) else x for n, x in enumerate(expected_base(row[1]))))
        for row in AWKWARD
    )
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_an_empty_table_stays_empty(spark):
    assert la.scan(frames.empty(spark)).count() == 0


def test_query_matches_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op12_license_scans(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert tuple(row)[1:6] == expected_base(texts[row["doc_id"]])
        labels = set(filter(None, row["labels"].split(",")))
        assert set(filter(None, row["base_labels"].split(","))) <= labels
        assert row["labels"] == ",".join(sorted(labels))
        # Each notice that stands whole in the text gives its label.
        words = " ".join(split(texts[row["doc_id"]]))
        for label, notice in NOTICES:
            if f" {' '.join(split(notice))} " in f" {words} ":
                assert label in labels and row["score"] == 1.0
        assert bool(labels) == (row["score"] >= la.COVERED)
