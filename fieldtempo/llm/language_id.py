"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
text is the sum over all its segmentations into pieces, which a forward pass adds up. White space
ends a piece, so the sum is the product of the words' sums, and a word is scored once however often
it occurs. The probabilities come from a bounded sample of documents of each language by
expectation maximisation over all segmentations (forward and backward passes).

Texts are lower-cased. A character that is no piece has the same small probability everywhere.
Null texts and texts without a letter are ``und`` with score 0; so is every text if nothing could be
learned. Equal likelihoods go to the language that sorts first. Null ids are never learned from and
count as not held out. Of several texts of one id and language the one of the smallest SHA-256 is learned
from. Copies score alike.

Long words, such as sentences of languages written without spaces, are learned from and scored whole.
Where no piece reaches across a character's boundary every segmentation has a cut, so the stretches
between such cuts are summed side by side; a stretch without any cut is summed from window to window,
which bounds memory.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtempo.llm.pieces import SPACE, VOCABULARY, vocabulary
from fieldtempo.llm.sampling import bounded_sample, remainder

#: Documents of each language to learn from, and bytes of their texts: the bounds of the sample.
PER_LANGUAGE = 250
LANGUAGE_BYTES = 16 << 20
#: Longer texts are not learned from, so that a few do not fill the sample.
EXAMPLE_BYTES = 1 << 20
#: Distinct words of each language whose counts are learned from, the most frequent ones.
WORDS_PER_LANGUAGE = 60_000
ROUNDS = 4
LEARN_FOLD = 3
HELD_OUT = 1
UNKNOWN = 1e-7
#: Weight of the languages' mean in each language's probabilities.
BACKOFF = 0.05
#: Numbers (of words by languages) and characters that a worker remembers.
REMEMBERED = 3_000_000
REMEMBERED_CHARACTERS = 20_000_000
#: Numbers (of characters by languages) summed at a time.
AT_ONCE = 1_600_000
#: Characters of a language whose segmentations are kept between the rounds; more are built anew.
KEPT_CHARACTERS = 2_000_000
LETTER = regex.compile(r"\p{L}")
#: A pass multiplies by this for every character, to stay within range; every SCALE_STEP characters
#: it also divides by what it has reached.
PER_CHARACTER = 200.0
SCALE_STEP = 32

BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 21


class PieceMatcher:
    """All occurrences of pieces in words, by rolling hashes of each length."""

    def __init__(self, pieces: tuple[str, ...]):
        self.longest = max(map(len, pieces))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        by_length = defaultdict(list)
        for n, piece in enumerate(pieces):
            by_length[len(piece)].append((n, piece))
        for length, found in by_length.items():
            codes = np.array([[ord(c) for c in piece] for _, piece in found], np.uint64)
            hashes = np.zeros(len(found), np.uint64)
            for at in range(length):
                hashes = self._step(hashes, codes[:, at])
            order = np.argsort(hashes)
            self.tables[length] = (hashes[order], np.array([n for n, _ in found])[order])
            self.filter[hashes >> np.uint64(64 - FILTER_BITS)] = True

    @staticmethod
    def _step(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (hashes ^ (codes + np.uint64(1))) * BASE + (hashes >> np.uint64(29))

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence, where ``left`` counts the characters from each
        position to the end of its word."""
        starts, ends, found = [], [], []
        alive = np.arange(len(codes))
        hashes = np.zeros(len(codes), np.uint64)
        for length in range(1, self.longest + 1):
            fits = left[alive] >= length
            alive, hashes = alive[fits], hashes[fits]
            if not len(alive):
                break
            hashes = self._step(hashes, codes[alive + (length - 1)])
            if length not in self.tables:
                continue
            table, numbers = self.tables[length]
            maybe = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
            place = np.searchsorted(table, hashes[maybe])
            hit = table[np.minimum(place, len(table) - 1)] == hashes[maybe]
            start = alive[maybe[hit]]
            starts.append(start)
            ends.append(start + length)
            found.append(numbers[place[hit]])
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(found)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _edges(
    codes: np.ndarray, left: np.ndarray, matcher: PieceMatcher
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces, and for a character that is none an edge of its own, of piece -1."""
    starts, ends, pieces = matcher.edges(codes, left)
    covered = np.zeros(len(codes), bool)
    covered[starts[ends == starts + 1]] = True
    bare = np.flatnonzero(~covered)
    return (
        np.concatenate([starts, bare]),
        np.concatenate([ends, bare + 1]),
        np.concatenate([pieces, np.full(len(bare), -1)]),
    )


def _uncut(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """For each character whether an edge reaches across its beginning."""
    steps = np.bincount(starts + 1, minlength=size + 2) - np.bincount(ends, minlength=size + 2)
    return np.cumsum(steps)[:size] > 0


class Lattice:
    """The segmentations of many words at once, as stretches that no edge leaves. Node i of a stretch
    lies before its character i."""

    def __init__(self, words: list[str], matcher: PieceMatcher, marked: bool = False):
        marked_words = words if marked else [SPACE + word for word in words]
        sizes = np.array([len(word) for word in marked_words])
        codes = _codes("".join(marked_words))
        start_of = np.cumsum(sizes) - sizes
        of_word = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(codes)) - start_of[of_word]
        starts, ends, pieces = _edges(codes, sizes[of_word] - within, matcher)
        first = np.flatnonzero(~_uncut(starts, ends, len(codes)))
        lengths = np.diff(np.append(first, len(codes)))
        word = np.repeat(np.arange(len(first)), lengths)
        self.word_of = of_word[first]
        self.words = len(sizes)
        owner = word[starts]
        # One node more than characters in each word.
        self.start, self.end, self.piece = starts + owner, ends + owner, pieces
        self.depth = ends - first[owner]
        self.from_depth = starts - first[owner]
        self.size = ends - starts
        self.owner = owner
        self.lengths = lengths
        self.nodes = len(codes) + len(first)
        self.first = first + np.arange(len(first))
        self.last = self.first + lengths
        self.within = np.arange(self.nodes) - np.repeat(self.first, lengths + 1)

    def _steps(self, depth: np.ndarray, node: np.ndarray) -> Iterator[tuple]:
        """Edges of the same depth, with where those of each node begin, and these nodes."""
        order = np.lexsort((node, depth))
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        for step in np.split(order, cuts):
            at = node[step]
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            yield step, begin, at[begin]

    def forward(self, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled sums at the nodes, the weights of the edges, and the logarithm of each word's
        probability."""
        alpha, weight, totals = self._sums(probability)
        begin = np.searchsorted(self.word_of, np.arange(self.words))
        return alpha, weight, np.add.reduceat(totals, begin, axis=0)

    def _sums(
        self, probability: np.ndarray, shift: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled sums at the nodes, the weights of the edges, and the logarithm of each stretch's
        probability; ``probability`` has a row for each piece, the last for the unknown. ``shift``
        gets the logarithm of what the sum at each node has been divided by."""
        languages = probability.shape[1]
        weight = probability[self.piece] * PER_CHARACTER ** self.size[:, None]
        alpha = np.zeros((self.nodes, languages))
        alpha[self.first] = 1.0
        scale = np.zeros((len(self.lengths), languages))
        for step, begin, nodes in self._steps(self.depth, self.end):
            alpha[nodes] = np.add.reduceat(alpha[self.start[step]] * weight[step], begin, axis=0)
            depth = int(self.depth[step[0]])
            if depth % SCALE_STEP == 0:
                self._rescale(alpha, scale, depth, max(0, depth - SCALE_STEP), shift)
        if shift is not None:
            # No later scaling has reached the nodes behind the last one of their word.
            behind = self.within > np.repeat((self.lengths - 1) // SCALE_STEP, self.lengths + 1) * SCALE_STEP
            shift[behind] = np.repeat(scale, self.lengths + 1, axis=0)[behind]
        total = np.log(np.maximum(alpha[self.last], 1e-300))
        return alpha, weight, total + scale - self.lengths[:, None] * np.log(PER_CHARACTER)

    def _rescale(
        self, sums: np.ndarray, scale: np.ndarray, depth: int, first: int, shift: np.ndarray | None
    ) -> None:
        """Divides the nodes of the long words that a later edge can reach, a step's nodes from
        ``first`` on, by the largest of them."""
        long = np.flatnonzero(self.lengths > depth)
        if not len(long):
            return
        reach = np.minimum(np.arange(first, first + SCALE_STEP + 1), self.lengths[long][:, None])
        nodes = self.first[long][:, None] + reach
        most = np.maximum(sums[nodes].max(axis=1), 1e-300)
        sums[nodes] /= most[:, None, :]
        scale[long] += np.log(most)
        if shift is not None:
            shift[nodes] = scale[long][:, None, :]

    def expected(self, probability: np.ndarray, counts: np.ndarray, pieces: int) -> np.ndarray:
        """Expected occurrences of each piece in one language."""
        before, after = np.zeros((self.nodes, 1)), np.zeros((self.nodes, 1))
        alpha, weight, total = self._sums(probability, before)
        beta = np.zeros((self.nodes, 1))
        beta[self.last] = 1.0
        scale = np.zeros((len(self.lengths), 1))
        for step, begin, nodes in self._steps(-self.from_depth, self.start):
            beta[nodes] = np.add.reduceat(beta[self.end[step]] * weight[step], begin, axis=0)
            depth = int(self.from_depth[step[0]])
            if depth and depth % SCALE_STEP == 0:
                self._rescale(beta, scale, depth, depth, after)
        early = self.within < SCALE_STEP
        after[early] = np.repeat(scale, self.lengths + 1, axis=0)[early]
        total = total[:, 0] + self.lengths * np.log(PER_CHARACTER)
        shift = before[self.start, 0] + after[self.end, 0] - total[self.owner]
        with np.errstate(divide="ignore"):
            share = np.log(alpha[self.start, 0]) + np.log(weight[:, 0]) + np.log(beta[self.end, 0])
        share = np.exp(share + shift) * counts[self.word_of[self.owner]]
        return np.bincount(self.piece % (pieces + 1), share, minlength=pieces + 1)[:pieces]


def long_total(word: str, probability: np.ndarray, matcher: PieceMatcher, window: int) -> np.ndarray:
    """The logarithm of a long word's probability by language; memory depends on the window alone."""
    text = SPACE + word
    reach = matcher.longest
    languages = probability.shape[1]
    total = np.zeros(languages)
    at = 0
    while at < len(text):
        # Edges that begin in the window are all known where the longest piece ends behind it.
        part = text[at : at + window + reach]
        last = at + len(part) == len(text)
        codes = _codes(part)
        starts, ends, pieces = _edges(codes, np.arange(len(part), 0, -1), matcher)
        if last:
            return total + Lattice([part], matcher, marked=True).forward(probability)[2][0]
        uncut = _uncut(starts, ends, len(part))
        cuts = np.flatnonzero(~uncut[: window + 1])
        if len(cuts) and cuts[-1]:
            cut = int(cuts[-1])
            total += Lattice([part[:cut]], matcher, marked=True).forward(probability)[2][0]
            at += cut
            continue
        more, at = _through_windows(text, at, probability, matcher, window)
        total += more
    return total


def _through_windows(
    text: str, at: int, probability: np.ndarray, matcher: PieceMatcher, window: int
) -> tuple[np.ndarray, int]:
    """The sum of a stretch from ``at`` to its end or the next cut, character by character; and where
    it ends."""
    reach = matcher.longest
    ahead = np.zeros((reach + 1, probability.shape[1]))
    ahead[0] = 1.0
    total = np.zeros(probability.shape[1])
    begun = at
    while at < len(text):
        part = text[at : at + window + reach]
        size = min(window, len(part))
        starts, ends, pieces = _edges(_codes(part), np.arange(len(part), 0, -1), matcher)
        order = np.argsort(starts, kind="stable")
        starts, sizes, pieces = starts[order], (ends - starts)[order], pieces[order]
        weight = probability[pieces] * PER_CHARACTER ** sizes[:, None]
        bounds = np.searchsorted(starts, np.arange(size + 1)).tolist()
        for place in range(size):
            here = ahead[0].copy()
            if at + place > begun and not ahead[1:].any():
                # No edge reaches across: all sums are here.
                return total + np.log(np.maximum(here, 1e-300)), at + place
            if place % SCALE_STEP == 0:
                most = np.maximum(ahead.max(axis=0), 1e-300)
                ahead /= most
                here /= most
                total += np.log(most)
            low, high = bounds[place], bounds[place + 1]
            ahead[sizes[low:high]] += here * weight[low:high]
            ahead[:-1] = ahead[1:]
            ahead[-1] = 0.0
            total -= np.log(PER_CHARACTER)
        at += size
    return total + np.log(np.maximum(ahead[0], 1e-300)), at


@dataclass
class LanguageModel:
    """Log probability of words by language, from piece probabilities."""

    path: str
    languages: list[str]
    probability: np.ndarray

    def matcher(self) -> PieceMatcher:
        return PieceMatcher(vocabulary(self.path).pieces)

    def word_scores(self, words: list[str], matcher: PieceMatcher) -> np.ndarray:
        most = max(1000, AT_ONCE // max(1, len(self.languages)))
        scores = np.zeros((len(words), len(self.languages)))
        long = [n for n, word in enumerate(words) if len(word) >= most]
        for n in long:
            scores[n] = long_total(words[n], self.probability, matcher, most)
        # Words of like length share a chunk, as a chunk takes as many steps as its longest stretch.
        short = sorted(set(range(len(words))).difference(long), key=lambda n: len(words[n]))
        held, size = [], 0
        for n in chain(short, [-1]):
            if held and (n < 0 or size >= most):
                lattice = Lattice([words[i] for i in held], matcher)
                scores[held] = lattice.forward(self.probability)[2]
                held, size = [], 0
            if n >= 0:
                held.append(n)
                size += len(words[n]) + 1
        return scores

    def predictor(self):
        """A function from a list of texts to their languages and scores; remembers words."""
        matcher = self.matcher()
        known: defaultdict[str, int] = defaultdict(count().__next__)
        scores = np.zeros((0, len(self.languages)))
        characters = 0

        def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
            nonlocal known, scores, characters
            if scores.size > REMEMBERED or characters > REMEMBERED_CHARACTERS:
                known = defaultdict(count().__next__)
                scores = np.zeros((0, len(self.languages)))
                characters = 0
            before = len(known)
            numbers = [[known[w] for w in text.lower().split()] if text else [] for text in texts]
            if len(known) > before:
                new = list(known)[before:]
                characters += sum(map(len, new))
                scores = np.concatenate([scores, self.word_scores(new, matcher)])
            predicted, certain = [], []
            for text, places in zip(texts, numbers):
                if not places or not self.languages or not LETTER.search(text):
                    predicted.append("und")
                    certain.append(0.0)
                    continue
                held, times = np.unique(places, return_counts=True)
                total = times @ scores[held]
                best = int(total.argmax())
                predicted.append(self.languages[best])
                certain.append(float(1.0 / np.exp(total - total[best]).sum()))
            return predicted, certain

        return predict


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(*[column.to_pylist() for column in batch.columns]):
            found = Counter((text or "").lower().split())
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(found), pa.string()),
                    "word": pa.array(list(found), pa.string()),
                    "n": pa.array(list(found.values()), pa.int64()),
                }
            )


def fit(docs: DataFrame, path: str = VOCABULARY) -> LanguageModel:
    """Learns from documents with a language whose remainder is not that of the held-out fold."""
    fold = remainder(F.col("doc_id"), LEARN_FOLD)
    learn = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where(
        (fold != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    ids = learn.where(F.octet_length("text") <= EXAMPLE_BYTES).select("doc_id", "lang").distinct()
    chosen = F.broadcast(bounded_sample(ids, "lang", PER_LANGUAGE))
    texts = (
        learn.where(F.octet_length("text") <= EXAMPLE_BYTES)
        .join(chosen, ["doc_id", "lang"])
        .groupBy("doc_id", "lang")
        .agg(F.min(F.struct(F.sha2("text", 256), "text")).alias("least"))
        .select("doc_id", "lang", "least.text")
    )
    # At most PER_LANGUAGE rows of a language stand here.
    so_far = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(2), "doc_id"), "doc_id")
    texts = texts.withColumn("bytes", F.sum(F.octet_length("text")).over(so_far))
    counted = (
        texts.where(F.col("bytes") <= LANGUAGE_BYTES)
        .select("lang", "text")
        .mapInArrow(_word_counts, "lang string, word string, n bigint")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    most = counted.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= WORDS_PER_LANGUAGE
    )
    words: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for row in most.select("lang", "word", "n").toArrow().to_pylist():
        words[row["lang"]].append((row["word"], row["n"]))
    languages = sorted(words)
    pieces = vocabulary(path).pieces
    matcher = PieceMatcher(pieces)
    by_language = []
    for language in languages:
        by_language.append(_learned(words[language], matcher, len(pieces)))
    if not languages:
        return LanguageModel(path, [], np.zeros((len(pieces) + 1, 0)))
    probability = np.stack(by_language, axis=1)
    mean = probability.mean(axis=1, keepdims=True)
    probability = (1 - BACKOFF) * probability + BACKOFF * mean
    unknown = np.full((1, len(languages)), UNKNOWN)
    return LanguageModel(path, languages, np.concatenate([probability, unknown]))


def _learned(words: list[tuple[str, int]], matcher: PieceMatcher, pieces: int) -> np.ndarray:
    """Piece probabilities of one language, in chunks of words to bound memory."""
    probability = np.full(pieces, 1.0 / pieces)
    # Words of like length share a chunk, as a chunk takes as many steps as its longest word.
    parts, size = [[]], 0
    for word, n in sorted(words, key=lambda x: (len(x[0]), x)):
        if size >= AT_ONCE // 4:
            parts, size = [*parts, []], 0
        parts[-1].append((word, n))
        size += len(word) + 1
    kept: dict[int, Lattice] = {}
    free = KEPT_CHARACTERS
    for _ in range(ROUNDS):
        column = np.append(probability, UNKNOWN)[:, None]
        expected = np.full(pieces, 0.01)
        for number, part in enumerate(parts):
            lattice = kept.get(number) or Lattice([w for w, _ in part], matcher)
            if number not in kept and int(lattice.lengths.sum()) <= free:
                kept[number] = lattice
                free -= int(lattice.lengths.sum())
            expected += lattice.expected(column, np.array([n for _, n in part], float), pieces)
        probability = expected / expected.sum()
    return probability


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predictor()
        for batch in batches:
            # Some rows at a time, so that what is remembered stays near its bound.
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                predicted, certain = predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(predicted, pa.string()),
                        pa.array(certain, pa.float64()),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    held_out = F.coalesce(remainder(F.col("doc_id"), LEARN_FOLD) == HELD_OUT, F.lit(False))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), "text"
    ).mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
