"""Token counts by section, from one encoding of the whole document.

A document is encoded once, whole. The bytes of its tokens add up to the bytes of its text, so their
running sum gives each token's span, mapped from bytes to characters; a token that holds part of a
character has that character in its span. Spans are joined to the sections by interval, both being in
order, and a token that reaches into several sections goes to one of them by an explicit rule:

* ``first``: the section of its first character;
* ``last``: the section of its last character;
* ``most``: the section that holds most of its characters, the earlier one on a tie.

Sections are ordered, disjoint spans of characters, end exclusive. A token none of whose characters
lies in a section counts as outside; an empty section has no tokens. The counts of the sections and
the tokens outside add up to the tokens of the document. Null text is encoded as empty, null sections
count as none. Copies and repeated rows give a row each; an empty table gives no rows. Only the
columns named are read, so further columns may have any name. Very long runs of white space, on which
the encoder's pattern would run out of stack, are cut out of the text beforehand; the ids are those of
the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that belongs to the rank file; a fixed value.
PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
#: What the pattern takes for white space, and the length from which a run of it is cut out.
WHITE_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 10_000
SENTENCE_END = r"(?<=[.!?]\s)"
RULES = ("first", "last", "most")
SECTIONS_TYPE = "array<struct<start:bigint,`end`:bigint>>"
COUNTS_TYPE = "n_tokens bigint, section_tokens array<bigint>, n_crossing bigint, n_outside bigint"


@lru_cache(maxsize=2)
def encoder(path: str = RANKS) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """The encoding of a whole text, and the bytes of each token id."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, n in ranks.items():
        sizes[n] = len(token)
    encoding = tiktoken.Encoding(
        "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
    )

    def encode(text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for run in re.finditer(f"{WHITE_SPACE}{{{LONG_RUN},}}", text):
            # One match of the pattern, but for the last character where something follows it.
            end = run.end() - (run.end() < len(text))
            ids += encoding.encode_ordinary(text[at : run.start()])
            ids += encoding._encode_single_piece(text[run.start() : end])
            at = end
        return ids + encoding.encode_ordinary(text[at:])

    return encode, sizes


def token_spans(text: str, ids: list[int], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters."""
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    if len(raw) == len(text):
        return starts, ends
    # Characters that begin before each byte: a byte's character is that count, less one, after it.
    begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return begun[starts + 1] - 1, begun[ends]


def attribute(
    starts: np.ndarray, ends: np.ndarray, section_start: np.ndarray, section_end: np.ndarray, rule: str
) -> tuple[np.ndarray, int, int]:
    """Tokens of each section, tokens that cross a boundary, and tokens outside all sections."""
    sections = len(section_start)
    if not sections or not len(starts):
        return np.zeros(sections, np.int64), 0, len(starts)
    # Sections that a token overlaps are those from the first that ends behind its start to the
    # last that starts before its end; empty sections end where they start and are never overlapped.
    full = np.flatnonzero(section_end > section_start)
    s, e = section_start[full], section_end[full]
    if not len(full):
        return np.zeros(sections, np.int64), 0, len(starts)
    low = np.searchsorted(e, starts, "right")
    high = np.searchsorted(s, ends, "left") - 1
    inside = low <= high
    partly = inside & (
        (high > low)
        | (starts < s[np.minimum(low, len(s) - 1)])
        | (ends > e[np.maximum(high, 0)])
    )
    owner = low.copy() if rule != "last" else high.copy()
    if rule == "most":
        two = np.flatnonzero(inside & (high == low + 1))
        before = e[low[two]] - np.maximum(s[low[two]], starts[two])
        behind = np.minimum(e[high[two]], ends[two]) - s[high[two]]
        owner[two] = np.where(before >= behind, low[two], high[two])
        for token in np.flatnonzero(inside & (high > low + 1)).tolist():
            places = np.arange(low[token], high[token] + 1)
            overlap = np.minimum(e[places], ends[token]) - np.maximum(s[places], starts[token])
            owner[token] = places[int(overlap.argmax())]
    counts = np.zeros(sections, np.int64)
    counts[full] = np.bincount(owner[inside], minlength=len(full))
    return counts, int(partly.sum()), int((~inside).sum())


def sentence_lengths(text: Column) -> Column:
    """The lengths of the sentences of a text. One ends behind the white space that follows a full
    stop, question or exclamation mark, and a token may hold that space and the next word."""
    sentences = F.split(F.coalesce(text, F.lit("")), SENTENCE_END, -1)
    return F.transform(sentences, F.char_length)


def count_by_section(
    docs: DataFrame,
    sections: Column,
    rule: str = "most",
    key: str = "doc_id",
    text: str = "text",
    path: str = RANKS,
) -> DataFrame:
    """The key with the tokens of the whole text, those of each section in order, those that cross
    the boundary of a section, and those outside all sections.

    ``sections`` is an array of structs ``start``, ``end`` for each row, or an array of the lengths
    of sections that follow each other without a gap.
    """
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = encoder(path)
        for batch in batches:
            results = []
            for whole, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = encode(whole or "")
                starts, ends = token_spans(whole or "", ids, sizes)
                counts, crossing, outside = attribute(starts, ends, *_bounds(spans), rule)
                results.append((len(ids), counts, crossing, outside))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in results], pa.int64()),
                    pa.array([r[1] for r in results], pa.list_(pa.int64())),
                    pa.array([r[2] for r in results], pa.int64()),
                    pa.array([r[3] for r in results], pa.int64()),
                ],
                names=["key", "n_tokens", "section_tokens", "n_crossing", "n_outside"],
            )

    rows = docs.select(
        F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), sections.alias("sections")
    )
    return rows.mapInArrow(run, f"key bigint, {COUNTS_TYPE}").withColumnRenamed("key", key)


def _bounds(spans: list | None) -> tuple[np.ndarray, np.ndarray]:
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if isinstance(spans[0], dict):
        return (
            np.array([x["start"] for x in spans], np.int64),
            np.array([x["end"] for x in spans], np.int64),
        )
    lengths = np.array(spans, np.int64)
    ends = np.cumsum(lengths)
    return ends - lengths, ends
