"""Licence wording found by a generalised suffix automaton of the words of all templates.

The automaton knows every run of words of every template. A text is streamed through it once, which
gives its matching statistics: at each word the longest run of template words that ends there. Runs
that cannot be continued, and are long, are chained: as long as the next one lies further on in the
same template, with not too many words between, it belongs to the same copy of it. A chain that covers
enough of its template is a span, and gives the text the template's label; so is each place of a whole
template, which shows in the state reached there and its suffixes. Base phrases are templates of which
only whole places count.

Words are runs of ASCII letters and digits and of any other characters beyond ASCII, A-Z in lower case.
Two words that follow each other in no template end every run there, so only the stretches between
such places go through the automaton. Null texts are empty, texts without words have score 0, repeated
rows and ids are each a row, an empty table gives no rows. What a task holds beside the automaton is a
number for each word of one text. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtempo.llm.license_templates import NOTICES, PHRASES

#: Words of a match that is chained; whole templates of fewer words are as well.
LONG = 4
#: Words of the text between two matches of one chain, at most.
MOST_GAP = 12
#: Share of its template that a span covers, at least.
COVERED = 0.6
#: Bytes of a text that are split into words at once, about.
CHUNK = 1 << 20

#: Label, first and last word, words covered, words of the template.
Span = tuple[str, int, int, int, int]

SPAN = "struct<label:string,first:bigint,last:bigint,covered:int,size:int>"
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    f"base_labels array<string>, spans array<{SPAN}>, score double"
)


def _letters() -> bytes:
    """For bytes.translate: letters lower, digits and bytes beyond ASCII as they are, the rest spaces."""
    return bytes(
        b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
        for b in range(256)
    )


LETTERS = _letters()


def word_chunks(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, some at a time."""
    plain = (text or b"").translate(LETTERS)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + CHUNK)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def words(text: str) -> list[bytes]:
    return [word for chunk in word_chunks(text.encode()) for word in chunk]


@dataclass
class SuffixAutomaton:
    """States with their transitions, suffix links, and the length of their longest string."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _parted(self, before: int, state: int, word: int) -> int:
        """The state of exactly the strings of ``before`` and a word, taken out of a larger state."""
        if self.length[state] == self.length[before] + 1:
            return state
        own = self._state(self.length[before] + 1, dict(self.step[state]), self.link[state])
        self.link[state] = own
        while before >= 0 and self.step[before].get(word) == state:
            self.step[before][word] = own
            before = self.link[before]
        return own

    def extend(self, last: int, word: int) -> int:
        """The state of the string of ``last`` and one more word, added where it is new."""
        if word in self.step[last]:
            return self._parted(last, self.step[last][word], word)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._parted(last, self.step[last][word], word)
        return new

    def by_length(self) -> list[int]:
        return sorted(range(len(self.length)), key=self.length.__getitem__)


@dataclass
class LicenseIndex:
    """The automaton of the templates, base phrases first, where in them each state's strings end, and
    which whole templates are suffixes of them."""

    labels: list[str]
    sizes: list[int]
    base: int
    vocabulary: dict[bytes, int]
    automaton: SuffixAutomaton
    #: By state and template: the words after the ends, in order.
    ends: list[dict[int, list[int]]]
    #: By state: (template, its number of words).
    whole: list[list[tuple[int, int]]]
    #: Which words follow each other in a template, and which are one on their own.
    follows: np.ndarray
    alone: np.ndarray

    @classmethod
    def build(
        cls,
        notices: Iterable[tuple[str, str]] = NOTICES,
        phrases: Iterable[tuple[str, str]] = PHRASES,
    ) -> LicenseIndex:
        phrases = list(phrases)
        named = [*phrases, *notices]
        vocabulary: dict[bytes, int] = {}
        texts = [[vocabulary.setdefault(w, len(vocabulary)) for w in words(t)] for _, t in named]
        automaton = SuffixAutomaton()
        for text in texts:
            last = 0
            for word in text:
                last = automaton.extend(last, word)
        ends: list[set[tuple[int, int]]] = [set() for _ in automaton.length]
        own: list[list[tuple[int, int]]] = [[] for _ in automaton.length]
        for template, text in enumerate(texts):
            state = 0
            for n, word in enumerate(text):
                state = automaton.step[state][word]
                ends[state].add((template, n + 1))
            if text:
                own[state].append((template, len(text)))
        order = automaton.by_length()[1:]
        for state in reversed(order):
            ends[automaton.link[state]] |= ends[state]
        whole: list[list[tuple[int, int]]] = [[] for _ in automaton.length]
        by_template: list[dict[int, list[int]]] = [{} for _ in automaton.length]
        for state in order:
            whole[state] = own[state] + whole[automaton.link[state]]
            for template, place in sorted(ends[state]):
                by_template[state].setdefault(template, []).append(place)
        follows = np.zeros((len(vocabulary) + 1, len(vocabulary) + 1), bool)
        alone = np.zeros(len(vocabulary) + 1, bool)
        for text in texts:
            follows[text[:-1], text[1:]] = True
            alone[text if len(text) == 1 else []] = True
        return cls(
            [label for label, _ in named],
            [len(text) for text in texts],
            len(phrases),
            vocabulary,
            automaton,
            by_template,
            whole,
            follows,
            alone,
        )

    def numbers(self, text: bytes | None) -> np.ndarray:
        """The numbers of a text's words; of words in no template one that follows nothing."""
        find, other = self.vocabulary.get, len(self.vocabulary)
        parts = [
            np.fromiter(map(find, chunk, repeat(other)), np.int32, len(chunk))
            for chunk in word_chunks(text)
        ]
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def stretches(self, found: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Where words follow each other as in some template: the first one's place, and the words."""
        joined = self.follows[found[:-1], found[1:]]
        edge = np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8))
        # A stretch of n joints has one word more.
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + 1).tolist()))
        if self.alone.any():
            joint = np.concatenate([[False], joined]) | np.concatenate([joined, [False]])
            single = np.flatnonzero(self.alone[found] & ~joint)
            spans = sorted(spans + [(n, n + 1) for n in single.tolist()])
        for start, end in spans:
            yield start, found[start:end].tolist()

    def matching_statistics(self, stretch: list[int]) -> Iterator[tuple[int, int]]:
        """At each word the longest run of template words that ends there: its state and length."""
        step, link, lengths = self.automaton.step, self.automaton.link, self.automaton.length
        state = length = 0
        for word in stretch:
            while state and word not in step[state]:
                state = link[state]
                length = lengths[state]
            if word in step[state]:
                state = step[state][word]
                length += 1
            yield state, length

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[Span], float]:
        """Number of words, base places (start, phrase), spans by place, and the largest share of a
        template that is covered."""
        found = self.numbers(text)
        places: list[tuple[int, int]] = []
        chains = _Chains(self)
        for start, stretch in self.stretches(found):
            before = (0, 0)
            for n, now in enumerate(self.matching_statistics(stretch), start):
                state, length = now
                for template, size in self.whole[state]:
                    if size <= length:
                        chains.found(template, n - size + 1, n, size)
                        if template < self.base:
                            places.append((n - size + 1, template))
                if length <= before[1]:
                    chains.add(n, *before)
                before = now
            chains.add(start + len(stretch), *before)
        return len(found), places, chains.closed(), chains.best


class _Chains:
    """The open chain of each template: first word, end in the text, end in the template, covered."""

    def __init__(self, index: LicenseIndex):
        self.index = index
        self.open: dict[int, tuple[int, int, int, int]] = {}
        self.spans: set[Span] = set()
        self.best = 0.0

    def found(self, template: int, first: int, last: int, covered: int) -> None:
        size = self.index.sizes[template]
        self.best = max(self.best, covered / size)
        if covered >= COVERED * size:
            self.spans.add((self.index.labels[template], first, last, covered, size))

    def _close(self, template: int) -> None:
        first, end, _, covered = self.open.pop(template)
        self.found(template, first, end - 1, covered)

    def add(self, end: int, state: int, length: int) -> None:
        """A match that ends before word ``end`` and cannot be continued."""
        for template, places in self.index.ends[state].items():
            if template < self.index.base or length < min(LONG, self.index.sizes[template]):
                continue
            chain = self.open.get(template)
            if chain is not None:
                first, text_end, template_end, covered = chain
                later = next((p for p in places if p > template_end), None)
                if later is not None and end - length - text_end <= MOST_GAP:
                    # What overlaps the last match, here or in the template, is covered once.
                    new = min(length, later - template_end, end - text_end)
                    self.open[template] = (first, end, later, covered + new)
                    continue
                self._close(template)
            # The first of the places leaves the most of the template to come.
            self.open[template] = (end - length, end, places[0], length)

    def closed(self) -> list[Span]:
        for template in list(self.open):
            self._close(template)
        return sorted(self.spans, key=lambda span: (span[1], span[2], span))


def scan(docs: DataFrame, index: LicenseIndex | None = None) -> DataFrame:
    """Every row's words, base places and labels, spans of templates, and score."""
    index = index or LicenseIndex.build()
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for n_words, places, spans, score in map(index.scan, texts):
                starts = [start for start, _ in places]
                rows.append(
                    {
                        "n_words": n_words,
                        "n_base": len(places),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": sorted({index.labels[p] for _, p in places}),
                        "spans": [dict(zip(("label", "first", "last", "covered", "size"), s)) for s in spans],
                        "score": score,
                    }
                )
            found = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *found.columns], names=["doc_id", *found.schema.names]
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.list_(pa.string())),
        (
            "spans",
            pa.list_(
                pa.struct(
                    [
                        ("label", pa.string()),
                        ("first", pa.int64()),
                        ("last", pa.int64()),
                        ("covered", pa.int32()),
                        ("size", pa.int32()),
                    ]
                )
            ),
        ),
        ("score", pa.float64()),
    ]
)
