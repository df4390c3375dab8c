import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldtempo.llm import language_id
from fieldtempo.llm.entries import queries
from fieldtempo.llm.pieces import SPACE, vocabulary
from tests.llm import frames

PIECES = (SPACE, "a", "b", "ab", "ba", "aba", SPACE + "a", "bb", "abab")
MATCHER = language_id.PieceMatcher(PIECES)


def probabilities(languages=2):
    rng = np.random.default_rng(5)
    table = rng.random((len(PIECES), languages))
    return np.concatenate([table / table.sum(axis=0), np.full((1, languages), 1e-3)])


def total(word, table, language):
    """The sum over all segmentations, one by one."""
    if not word:
        return 1.0
    found = 0.0
    for n in range(1, len(word) + 1):
        if word[:n] in PIECES:
            found += table[PIECES.index(word[:n]), language] * total(word[n:], table, language)
    if word[0] not in PIECES:
        found += table[-1, language] * total(word[1:], table, language)
    return found


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abc", max_size=9), min_size=1, max_size=6))
def test_forward_sums_all_segmentations(words):
    table = probabilities()
    scores = language_id.Lattice(words, MATCHER).forward(table)[2]
    expected = [[np.log(total(SPACE + w, table, n)) for n in (0, 1)] for w in words]
    assert scores == pytest.approx(np.array(expected))


def test_long_words_are_scaled():
    table = probabilities()
    words = ["ab" * 40, "ab" * 4000]
    scores = language_id.Lattice(words, MATCHER).forward(table)[2]
    alpha = [1.0, 0.0, 0.0, 0.0]
    word, log = SPACE + words[1], 0.0
    reach = [1.0]
    for end in range(1, len(word) + 1):
        s = sum(
            table[PIECES.index(word[end - n : end]), 0] * reach[-n]
            for n in range(1, 5)
            if n <= len(reach) and word[end - n : end] in PIECES
        )
        reach = (reach + [s])[-4:]
        if s < 1e-100:
            reach = [x / s for x in reach]
            log += np.log(s)
    assert alpha and scores[1, 0] == pytest.approx(np.log(reach[-1]) + log, rel=1e-9)
    assert np.isfinite(scores).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abc", max_size=7), min_size=1, max_size=5, unique=True))
def test_expected_counts_cover_the_words(words):
    table = probabilities(1)
    counts = np.arange(1.0, len(words) + 1)
    expected = language_id.Lattice(words, MATCHER).expected(table, counts, len(PIECES))
    characters = (expected * [len(p) for p in PIECES]).sum()
    known = sum(n * sum(c in "ab" + SPACE for c in SPACE + w) for n, w in zip(counts, words))
    assert characters == pytest.approx(known)


def test_expected_counts_of_long_words_are_those_without_scaling(monkeypatch):
    table = probabilities(1)
    words = ["ab" * n + "c" * (n % 3) for n in (1, 16, 31, 32, 33, 47, 48, 64)] + ["ba" * 16 + "a"]
    counts = np.arange(1.0, len(words) + 1)
    scaled = language_id.Lattice(words, MATCHER).expected(table, counts, len(PIECES))
    with monkeypatch.context() as patched:
        patched.setattr(language_id, "SCALE_STEP", 1 << 20)
        whole = language_id.Lattice(words, MATCHER).expected(table, counts, len(PIECES))
    assert scaled == pytest.approx(whole, rel=1e-9)
    expected = language_id.Lattice(["ab" * 4000], MATCHER).expected(table, np.ones(1), len(PIECES))
    assert (expected * [len(p) for p in PIECES]).sum() == pytest.approx(8001)


def test_languages_without_spaces_are_learned(spark):
    rng = np.random.default_rng(3)
    letters = {"zh": "的一是不了人我在有他这中大来上", "ja": "のにはをたがでてとしれさある"}
    rows = [
        (n, "".join(rng.choice(list(letters[lang]), 200 + n)), lang)
        for n, lang in enumerate(["zh", "ja"] * 30)
    ] + [(n, "the cat sat on a mat and saw the dog", "en") for n in range(60, 90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["en", "ja", "zh"]
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predict_languages(docs, model).collect()}
    assert found == {n: lang for n, _, lang in rows}


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=120), st.integers(1, 30))
def test_a_word_summed_in_windows_has_the_sum_of_the_whole(word, window):
    table = probabilities()
    whole = language_id.Lattice([word], MATCHER).forward(table)[2][0]
    assert language_id.long_total(word, table, MATCHER, window) == pytest.approx(whole, rel=1e-9)


def test_stretches_are_cut_where_no_piece_reaches_across():
    lattice = language_id.Lattice(["abcab", "", "cc"], MATCHER)
    # A mark and what may follow it in one piece, or alone; an unknown letter is alone.
    assert lattice.lengths.tolist() == [3, 1, 2, 1, 1, 1, 1]
    assert lattice.word_of.tolist() == [0, 0, 0, 1, 2, 2, 2]


def test_very_long_runs_are_scored_in_bounded_memory(spark):
    rng = np.random.default_rng(3)
    signs = "的一是不了人我在有他这中大来上"
    rows = [(n, "".join(rng.choice(list(signs), 300)), "zh") for n in range(20)]
    rows += [(n, "the cat sat on a mat and saw the dog", "en") for n in range(20, 40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    model.probability = np.repeat(model.probability, 10, axis=1)
    model.languages = [f"{lang}{n}" for lang in model.languages for n in range(10)]
    predict = model.predictor()
    tracemalloc.start()
    predicted, _ = predict(["".join(rng.choice(list(signs), 2_000_000)), "the dog sat " * 200_000, "x" * 100_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert predicted[:2] == ["zh0", "en0"]
    assert peak < 600e6


def test_the_sample_holds_distinct_documents(spark):
    rows = [(n, f"word{n} and more", "xx") for n in range(1000)]
    rows += [(5, "word5 and more", "xx")] * 400 + [(n, "another text of the id", "xx") for n in range(0, 1000, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = []
    for parts in (1, 6):
        model = language_id.fit(docs.repartition(parts, "text"))
        found.append(model.probability)
    assert (found[0] == found[1]).all()
    ids = docs.where(language_id.remainder(F.col("doc_id"), 3) != 1).select("doc_id", "lang").distinct()
    assert language_id.bounded_sample(ids, "lang", 250).distinct().count() == 250


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGE_BYTES", 2_000)
    monkeypatch.setattr(language_id, "EXAMPLE_BYTES", 500)
    seen = []
    monkeypatch.setattr(
        language_id, "_learned", lambda words, matcher, pieces: seen.append(words) or np.full(pieces, 1 / pieces)
    )
    rows = [(n, f"w{n} " * (40 if n % 9 else 4000), lang) for n in range(400) for lang in ("xx", "yy")]
    language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(seen) == 2
    for words in seen:
        assert 0 < sum(len(word) * n for word, n in words) <= 2_000


def test_matcher_finds_every_piece_of_the_public_vocabulary():
    matcher = language_id.PieceMatcher(vocabulary().pieces)
    text = "▁the▁información▁straße"
    codes = np.array([ord(c) for c in text], np.uint64)
    starts, ends, pieces = matcher.edges(codes, len(text) - np.arange(len(text)))
    known = {p: n for n, p in enumerate(vocabulary().pieces)}
    expected = {
        (a, b, known[text[a:b]])
        for a in range(len(text))
        for b in range(a + 1, min(len(text), a + 16) + 1)
        if text[a:b] in known
    }
    assert set(zip(starts.tolist(), ends.tolist(), pieces.tolist())) == expected


def test_awkward_rows(spark):
    docs = frames.awkward(spark)
    result = language_id.predict_languages(docs, language_id.fit(docs)).collect()
    assert len(result) == len(frames.AWKWARD)
    texts = {}
    for row in frames.AWKWARD:
        texts.setdefault(row[0], row[1])
    for r in result:
        if r["doc_id"] in (1, 2, 3, 7, 10):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert 0 <= r["score"] <= 1
        expected = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["held_out"] == expected
    none = frames.empty(spark)
    assert language_id.predict_languages(none, language_id.fit(none)).count() == 0
    unlearned = language_id.predict_languages(docs, language_id.fit(none)).collect()
    assert {r["lang_pred"] for r in unlearned} == {"und"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [r for r in queries()["op5_language_id"](spark, folder).collect() if r["held_out"]]
    assert len(held) > 250
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.98
