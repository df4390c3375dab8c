"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Features of a text are its lower-case words cut to their first letters, so that inflected forms meet. A
feature weighs what its logarithmic frequency in the text, its rarity among all documents, and its
chi-square against the label among the examples make of it; nothing is cut off, but what says nothing
about the label, as all that no example has, weighs nothing. The examples lie in blocks of similar
ones. For the features of the largest weights the index has the largest value in each block, and behind
it the postings of that block; of the light ones, which have most of the postings, the norm that they
have together in each example and, at most, in each block. A query sums largest values and the product
of norms to an upper bound for each block, then sums the postings of the blocks of the highest bounds,
and of those whose bound reaches the k-th best; the postings of the others are never touched. What can
still be among the k nearest gets the light features' share, so the cosines are exact. Votes are weighted by a power of the similarity over the distance, so that a copy of an
example decides, and by how much a class is under-represented in the sample, and smoothed with the base
rate; the neighbours are evidence.

Labels come only from documents whose CRC-32 remainder is not that of the held-out fold. The sample is
bounded in documents and bytes. Null and empty texts, and those that share no feature with an example,
get the base rate. Without any labels every score is 0. Null ids are never learned from and count as not
held out. Of several texts of one id the one of the smallest SHA-256 is learned from, and an id that is
labelled both ways is an example of each. Copies get equal scores. Further columns are carried whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtempo.llm.batches import parts, releasing
from fieldtempo.llm.sampling import bounded_sample, remainder

#: Labelled documents of each class to learn from, and bytes of their texts: the bounds of the sample.
PER_CLASS = 2000
CLASS_BYTES = 16 << 20
#: Longer texts are no examples, so that a few do not fill the sample.
EXAMPLE_BYTES = 1 << 18
#: Letters of a word that count.
LETTERS = 5
NEIGHBOURS = 15
BLOCK = 64
#: Weight of the base rate in a vote, in neighbours of similarity 1.
SMOOTHING = 0.25
#: Power of the similarity in a vote: neighbours that share little hardly count.
CLOSENESS = 3
#: Added to the distance a vote is divided by: little, so that an exact copy outvotes near ones.
DISTANCE = 1e-6
#: Share of all postings that features with postings by block have; the other features are light.
HEAVY_SHARE = 0.3
#: Blocks that are scored before any is left out.
FIRST_BLOCKS = 4
EVIDENCE = 5
#: Texts whose scores a task remembers.
REMEMBERED_TEXTS = 20_000
HELD_OUT_OF = 5
#: Directions in which examples are compared when they are dealt to blocks.
DIRECTIONS = 64
#: The first letters of a word, the group, and the rest of it.
WORD = re.compile(rf"([^\W\d_]{{1,{LETTERS}}})[^\W\d_]*")

EVIDENCE_TYPE = "array<struct<doc_id:bigint,similarity:double,toxic:int>>"


def features(text: str | None) -> Counter:
    """Features of a text, and how often they occur."""
    return Counter(WORD.findall((text or "").lower()))


def numbered(text: str | None, vocabulary: dict[str, int]) -> tuple[np.ndarray, bool]:
    """The numbers of a text's features, one for each occurrence of one that the vocabulary has, and
    whether the text has any word."""
    found = WORD.findall((text or "").lower())
    numbers = np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int64, len(found))
    return numbers[numbers >= 0], bool(found)


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places from each start to its end, one span after the other."""
    sizes = ends - starts
    shifted = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    shifted += np.arange(len(shifted))
    return shifted


def similar_order(rows: np.ndarray) -> np.ndarray:
    """An order of the rows in which neighbours are alike: halved again and again across the direction
    in which they differ most."""
    done: list[np.ndarray] = []
    left = [np.arange(len(rows))]
    while left:
        part = left.pop()
        if len(part) <= BLOCK:
            done.append(part)
            continue
        centred = rows[part] - rows[part].mean(0)
        _, directions = np.linalg.eigh(centred.T @ centred)
        along = part[np.lexsort((part, np.round(centred @ directions[:, -1], 9)))]
        # Whole blocks to the left, so that only the last one is not full.
        half = max(1, round(len(part) / 2 / BLOCK)) * BLOCK
        left += [along[half:], along[:half]]
    return np.concatenate([np.empty(0, np.int64), *done])


def _kth(scores: np.ndarray, k: int) -> float:
    """The k-th largest score; 0 if there are fewer."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0.0


@dataclass
class BlockMaxIndex:
    """Unit vectors of the examples in blocks. Entries are pairs of a heavy feature and a block that has
    it, by feature: the largest value, and where the postings begin. ``weight`` is what each feature
    weighs, ``votes`` what each example's class does."""

    vocabulary: dict[str, int]
    weight: np.ndarray
    labels: np.ndarray
    ids: list[int | None]
    votes: np.ndarray
    prior: float
    heavy: np.ndarray
    #: By feature: its first entry.
    begins: np.ndarray
    #: By entry: block, largest value, first posting.
    blocks: np.ndarray
    largest: np.ndarray
    firsts: np.ndarray
    #: By posting: example, value.
    examples: np.ndarray
    values: np.ndarray
    #: By block: the largest norm of light features. By example: norm and first of its light features;
    #: these and their values.
    block_light: np.ndarray
    light_norm: np.ndarray
    light_begins: np.ndarray
    light_features: np.ndarray
    light_values: np.ndarray

    @staticmethod
    def vector(found: list[int] | np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers, counts = np.unique(np.asarray(found, np.int64), return_counts=True)
        values = (1 + np.log(counts)) * weight[numbers]
        return numbers, values / (np.linalg.norm(values) or 1.0)

    @classmethod
    def build(
        cls,
        vocabulary: dict[str, int],
        df: list[int] | np.ndarray,
        total: int,
        examples: list[tuple[int | None, int, list[int] | np.ndarray]],
        class_sizes: dict[int, int],
        sampled: dict[int, int],
        relevance: np.ndarray | None = None,
    ) -> BlockMaxIndex:
        """``relevance`` is a factor of the weights."""
        weight = np.log((total + 1) / (np.array(df, float) + 1)) + 1
        if relevance is not None:
            weight = weight * relevance
        vectors = [cls.vector(found, weight) for _, _, found in examples]
        # Random signs keep angles, so a few sums are enough to tell what is alike.
        signs = np.random.default_rng(1).choice([-1.0, 1.0], (len(vocabulary), DIRECTIONS))
        rows = np.array([values @ signs[numbers] for numbers, values in vectors])
        order = similar_order(rows.reshape(len(vectors), DIRECTIONS)).tolist()
        labels = np.array([examples[n][1] for n in order], int)
        known = sum(class_sizes.values())
        # Each class stands for as many labels as were not sampled.
        votes = {
            label: class_sizes[label] / known * sum(sampled.values()) / n
            for label, n in sampled.items()
        }
        sizes = [len(vectors[n][0]) for n in order]
        example = np.repeat(np.arange(len(order)), sizes)
        feature = np.concatenate([np.empty(0, np.int64), *[vectors[n][0] for n in order]])
        value = np.concatenate([np.empty(0), *[vectors[n][1] for n in order]])
        postings = np.bincount(feature, minlength=len(vocabulary))
        by_weight = np.argsort(-weight, kind="stable")
        heavy = np.zeros(len(vocabulary), bool)
        heavy[by_weight] = np.cumsum(postings[by_weight]) <= HEAVY_SHARE * len(feature)
        light = ~heavy[feature]
        light_example, light_feature, light_value = example[light], feature[light], value[light]
        feature, example, value = feature[~light], example[~light], value[~light]
        by_feature = np.argsort(feature, kind="stable")
        feature, example, value = feature[by_feature], example[by_feature], value[by_feature]
        new = np.ones(len(feature), bool)
        new[1:] = (np.diff(feature) != 0) | (np.diff(example // BLOCK) != 0)
        first = np.flatnonzero(new)
        light_norm = np.sqrt(np.bincount(light_example, light_value**2, len(order)))
        starts = np.arange(0, len(order), BLOCK)
        return cls(
            vocabulary,
            weight,
            labels,
            [examples[n][0] for n in order],
            np.array([votes[x] for x in labels.tolist()], float),
            class_sizes.get(1, 0) / known if known else 0.0,
            heavy,
            np.searchsorted(feature[first], np.arange(len(vocabulary) + 1)),
            example[first] // BLOCK,
            np.maximum.reduceat(value, first) if len(first) else np.empty(0),
            np.append(first, len(feature)),
            example,
            value,
            np.maximum.reduceat(light_norm, starts) if len(starts) else np.empty(0),
            light_norm,
            np.searchsorted(light_example, np.arange(len(order) + 1)),
            light_feature,
            light_value,
        )

    def _summed(self, entries: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The sums of the postings of some entries by example."""
        starts, ends = self.firsts[entries], self.firsts[entries + 1]
        at = _spans(starts, ends)
        weights = self.values[at] * np.repeat(query, ends - starts)
        return np.bincount(self.examples[at], weights, len(self.labels))

    def _within(self, blocks: np.ndarray) -> np.ndarray:
        """The examples of some blocks."""
        places = np.flatnonzero(blocks)[:, None] * BLOCK + np.arange(BLOCK)
        places = places.ravel()
        return places[: np.searchsorted(places, len(self.labels))]

    def _light(self, some: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
        """What light features add to the cosines of some examples."""
        query = np.zeros(len(self.vocabulary))
        query[numbers] = values
        starts, ends = self.light_begins[some], self.light_begins[some + 1]
        at = _spans(starts, ends)
        weights = query[self.light_features[at]] * self.light_values[at]
        return np.bincount(np.repeat(np.arange(len(some)), ends - starts), weights, len(some))

    def nearest(
        self, found: list[int] | np.ndarray, k: int = NEIGHBOURS
    ) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and exact cosines of the k nearest examples, ties to the smaller number."""
        return self.searched(found, k)[:2]

    def searched(
        self, found: list[int] | np.ndarray, k: int = NEIGHBOURS
    ) -> tuple[np.ndarray, np.ndarray, int]:
        """The same, and how many blocks were scored."""
        numbers, values = self.vector(found, self.weight)
        heavy = self.heavy[numbers]
        light = float(np.linalg.norm(values[~heavy]))
        starts, ends = self.begins[numbers[heavy]], self.begins[numbers[heavy] + 1]
        entries, query = _spans(starts, ends), np.repeat(values[heavy], ends - starts)
        blocks = self.blocks[entries]
        bounds = np.bincount(blocks, self.largest[entries] * query, len(self.block_light))
        bounds = bounds + light * self.block_light
        few = min(max(FIRST_BLOCKS, -(-k // BLOCK)), len(bounds))
        chosen = np.zeros(len(bounds), bool)
        chosen[np.argpartition(bounds, len(bounds) - few)[len(bounds) - few :]] = True
        some = chosen[blocks]
        scores = self._summed(entries[some], query[some])
        # Light features only add, so the k-th of these sums is not above the k-th cosine.
        more = (bounds >= _kth(scores[self._within(chosen)], k) - 1e-9) & ~chosen
        if more.any():
            some = more[blocks]
            scores = scores + self._summed(entries[some], query[some])
        scored = self._within(chosen | more)
        scores = scores[scored]
        reach = scores + light * self.light_norm[scored]
        able = np.flatnonzero((reach >= _kth(scores, k) - 1e-9) & (reach > 0))
        best = scored[able]
        scores = scores[able] + self._light(best, numbers[~heavy], values[~heavy])
        best, scores = best[scores > 0], scores[scores > 0]
        # Rounded, so that equal cosines summed in another order stay ties.
        rounded = np.round(scores, 12)
        order = np.lexsort((best, -rounded))[:k]
        return best[order], np.minimum(scores[order], 1.0), int((chosen | more).sum())

    def score(self, found: np.ndarray) -> tuple[float, list[dict]]:
        if not len(found) or not len(self.labels):
            return self.prior, []
        best, similar = self.nearest(found)
        votes = similar**CLOSENESS / (1 - similar + DISTANCE) * self.votes[best]
        toxic = float((votes * self.labels[best]).sum())
        score = (toxic + SMOOTHING * self.prior) / (float(votes.sum()) + SMOOTHING)
        evidence = [
            {"doc_id": self.ids[n], "similarity": float(s), "toxic": int(self.labels[n])}
            for n, s in zip(best[:EVIDENCE].tolist(), similar[:EVIDENCE].tolist())
        ]
        return min(1.0, max(0.0, score)), evidence

    def scorer(self, evidence: bool = True):
        """A function from text to score and evidence that remembers texts, by their digest. Evidence
        takes far more memory than scores; without it there is none."""
        known: dict[bytes, tuple[float, list[dict]]] = {}

        def score(text: str | None) -> tuple[float, list[dict]]:
            name = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if name not in known:
                if len(known) >= REMEMBERED_TEXTS:
                    known.clear()
                found = self.score(numbered(text, self.vocabulary)[0])
                known[name] = found if evidence else (found[0], [])
            return known[name]

        return score


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of labelled documents outside the held-out fold, with their texts, and how
    many labels each class has. The sample is of labels, so its join broadcasts few small rows."""
    learn = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int"))
        .where(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), HELD_OUT_OF) != 0))
        .distinct()
    )
    sizes = {row["toxic"]: row["count"] for row in learn.groupBy("toxic").count().collect()}
    sample = bounded_sample(learn, "toxic", PER_CLASS)
    text = F.coalesce("text", F.lit("")).alias("text")
    short = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).where(
        F.octet_length("text") <= EXAMPLE_BYTES
    )
    one = (
        short.join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min(F.struct(F.sha2("text", 256), "text")).alias("least"))
        .select("doc_id", "toxic", "least.text")
    )
    # At most PER_CLASS rows of a class stand here.
    hashed = F.xxhash64(F.lit(2), "doc_id")
    so_far = Window.partitionBy("toxic").orderBy(hashed, "doc_id")
    return (
        one.withColumn("bytes", F.sum(F.octet_length("text")).over(so_far))
        .where(F.col("bytes") <= CLASS_BYTES)
        .select("doc_id", "toxic", "text"),
        sizes,
    )


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, toxic, text in zip(*[column.to_pylist() for column in batch.columns]):
            found = features(text)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([i], pa.int64()),
                    "toxic": pa.array([toxic], pa.int32()),
                    "features": pa.array([list(found)], pa.list_(pa.string())),
                    "counts": pa.array([list(found.values())], pa.list_(pa.int32())),
                }
            )


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and how many have any word."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    places = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        df = np.zeros(places + 1, np.int64)
        for batch in batches:
            for part in parts(batch, 0):
                for text in part.column(0).to_pylist():
                    found, any_word = numbered(text, vocabulary)
                    df[np.unique(found)] += 1
                    df[places] += any_word
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["place", "n"])

    counted = (
        docs.select("text")
        .mapInArrow(releasing(run), "place bigint, n bigint")
        .groupBy("place")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    shared.destroy()
    df = np.zeros(places + 1, np.int64)
    df[counted["place"].to_numpy()] = counted["n"].to_numpy()
    return df[:places], int(df[places])


def fit(docs: DataFrame, labels: DataFrame) -> BlockMaxIndex:
    sample, sizes = labelled(docs, labels)
    rows = (
        sample.select("doc_id", "toxic", "text")
        .mapInArrow(
            _sample_features,
            "doc_id bigint, toxic int, features array<string>, counts array<int>",
        )
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
        .combine_chunks()
    )
    # Empty texts have no features and say nothing about any.
    rows = rows.filter(pc.greater(pc.list_value_length(rows["features"]), 0))
    if not rows.num_rows:
        return BlockMaxIndex.build({}, [], 0, [], sizes, {})
    lists = rows["features"].combine_chunks()
    names = lists.flatten().dictionary_encode()
    vocabulary = {name: n for n, name in enumerate(names.dictionary.to_pylist())}
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())[:-1]
    found = np.split(names.indices.to_numpy().astype(np.int64), ends)
    counts = np.split(rows["counts"].combine_chunks().flatten().to_numpy(), ends)
    toxic = rows["toxic"].to_pylist()
    examples = [
        (i, label, np.repeat(numbers, n))
        for i, label, numbers, n in zip(rows["doc_id"].to_pylist(), toxic, found, counts)
    ]
    df, total = document_frequencies(docs, vocabulary)
    return BlockMaxIndex.build(
        vocabulary,
        df,
        total,
        examples,
        sizes,
        Counter(toxic),
        _relevance(found, np.array(toxic), len(vocabulary)),
    )


def _relevance(found: list[np.ndarray], toxic: np.ndarray, known: int) -> np.ndarray:
    """How much each feature tells of the label, from 0 to 1: its chi-square beside the largest that
    chance gives among so many features, squared. With labels of one kind all tell the same."""
    positive, negative = int((toxic == 1).sum()), int((toxic == 0).sum())
    if not positive or not negative:
        return np.ones(known)
    held = np.zeros((2, known))
    for label, numbers in zip(toxic.tolist(), found):
        held[label, numbers] += 1
    b, a = held
    total = positive + negative
    spread = (a + b) * (total - a - b)
    chi = total * (a * (negative - b) - b * (positive - a)) ** 2 / positive / negative
    chi = np.divide(chi, spread, out=np.zeros(known), where=spread > 0)
    return (chi / (chi + 2 * math.log(max(2, known)))) ** 2


def score_texts(docs: DataFrame, index: BlockMaxIndex) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            results = [score(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([s for s, _ in results], pa.float64()),
                    pa.array([int(s >= 0.5) for s, _ in results], pa.int32()),
                    pa.array(
                        [e for _, e in results],
                        pa.list_(
                            pa.struct(
                                [
                                    ("doc_id", pa.int64()),
                                    ("similarity", pa.float64()),
                                    ("toxic", pa.int32()),
                                ]
                            )
                        ),
                    ),
                ],
                names=["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    held_out = F.coalesce(remainder(F.col("doc_id"), HELD_OUT_OF) == 0, F.lit(False))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), "text"
    ).mapInArrow(
        run,
        f"doc_id bigint, held_out boolean, score double, predicted int, evidence {EVIDENCE_TYPE}",
    )


def without_toxic(docs: DataFrame, index: BlockMaxIndex) -> DataFrame:
    """The rows that are not predicted toxic, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = [name.lower() for name in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer(evidence=False)
        for batch in batches:
            for part in parts(batch, at):
                clean = [score(text)[0] < 0.5 for text in part.column(at).to_pylist()]
                yield part.filter(pa.array(clean, pa.bool_()))

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return docs.mapInArrow(releasing(run), schema)
