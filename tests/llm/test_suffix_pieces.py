import time

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldtempo.llm import suffix_pieces
from fieldtempo.llm.entries import documents, queries
from fieldtempo.llm.pieces import SPACE, VOCABULARY
from tests.llm import frames

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
ENCODER = suffix_pieces.Encoder()


def encoded(texts):
    values, bounds = ENCODER.encode(texts)
    return [values[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ctheingo\n\t.,▁éñ日\U0001f600\0ſ"), max_size=90), max_size=5))
def test_ids_are_those_of_the_library(texts):
    assert encoded(texts) == LIBRARY.encode(texts)
    for ids, text in zip(encoded(texts), texts):
        assert suffix_pieces.decode_ids(ids) == text.replace(SPACE, " ")


def test_long_stretches_and_empty_texts():
    texts = ["a" * 777, "ab" * 3000, " " * 301, "tion" * 400, "=" * 99, "", None, frames.LONG]
    assert encoded(texts) == LIBRARY.encode([t or "" for t in texts])


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abтиon的一是=のé9"), min_size=65, max_size=400))
def test_ids_of_long_stretches_are_those_of_the_library(text):
    assert encoded([text, text[:200] * 3]) == LIBRARY.encode([text, text[:200] * 3])


def test_text_without_spaces_is_encoded_in_proportion_to_its_length():
    draw = np.random.default_rng(4)
    signs, letters = list("的一是不了人我在有他这中大来上のにはをた"), list("etaoinshrdlu")
    texts = ["".join(draw.choice(signs, 200_000)), "".join(draw.choice(letters, 100_000))]
    texts += ["".join(draw.choice(letters, 100)) for _ in range(1000)]
    assert encoded(texts) == LIBRARY.encode(texts)
    # Many stretches of a hundred letters, each relaxed by itself.
    seconds = []
    for n in (1000, 4000):
        texts = ["".join(draw.choice(letters, 100)) for _ in range(n)]
        start = time.thread_time()
        suffix_pieces.Encoder.encode(ENCODER, texts)
        seconds.append(time.thread_time() - start)
    assert seconds[1] < 8 * seconds[0]


def test_suffix_ranges_hold_every_occurrence():
    text = "the thing then gathers, thé"
    codes = np.array([ord(c) for c in text])
    index = suffix_pieces.SuffixIndex(codes, 16)
    pieces = ["t", "th", "the", "then gathers, t", "zz", "é", "q"]
    padded = np.full((len(pieces), 16), -1)
    for n, piece in enumerate(pieces):
        padded[n, : len(piece)] = [ord(c) for c in piece]
    low, high = index.ranges(padded, np.array([len(p) for p in pieces]))
    for piece, a, b in zip(pieces, low, high):
        expected = [i for i in range(len(text)) if text.startswith(piece, i)]
        assert sorted(index.order[a:b].tolist()) == expected


def test_query_matches_the_library(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in documents(spark, folder).collect()}
    rows = queries()["op9_sentencepiece"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == LIBRARY.encode(texts[r["doc_id"]])
        assert r["round_trip"] and r["n_ids"] == len(r["ids"])


def test_awkward_rows_and_decoding(spark):
    docs = frames.awkward(spark)
    ids = suffix_pieces.encode(docs, check=True)
    assert ids.columns == [*[c for c in docs.columns if c != "text"], "ids", "round_trip"]
    rows = suffix_pieces.decode(ids).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows if r["doc_id"]) == sorted(
        (row[0], row[1] or "") for row in frames.AWKWARD if row[0]
    )
    assert suffix_pieces.encode(frames.empty(spark)).count() == 0
    assert suffix_pieces.decode(suffix_pieces.encode(frames.empty(spark))).count() == 0
