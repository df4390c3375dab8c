"""SimHash near-duplicates by covering the fingerprints with anchor points.

The bits are cut into parts, so few that one of them differs in at most one bit between any two
fingerprints within the threshold. In each part the anchors are the words of a Hamming code, which
cover every point within radius 1: each fingerprint has a home, the anchor within that radius. It is
replicated to every anchor within the covering radius plus the part's threshold, so of two linked
fingerprints each is found at the other's home. At each anchor whole fingerprints are compared, those
at home with all that are there, and links are kept as a forest, so a group of copies or near copies
never gives all its pairs. Components come from rounds of stars over the links.

Equal fingerprints are one point from the start, however many documents have them. An anchor that is
home to very many points deals them to groups, to each of which the replicas go, so what a task holds
is bounded and no link is lost.

Null text counts as empty. Texts without words have fingerprint zero, linked like any other. Null ids
are in no component's smallest id; a component of null ids alone has a null id. Repeated rows give
a row each, an empty table none, and further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtempo.llm.components import component_roots
from fieldtempo.llm.storage import free_names, small, written

BITS = 64
#: Fixed by the contract of the query.
SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Points at home at one anchor in one group.
HOME_POINTS = 8192
#: Points of a short run, compared by shifting the run along itself.
SHORT_RUN = 8
#: Shingles whose bits are counted at a time, and compared pairs held at a time.
SHINGLES = 65_536
PAIRS = 2_000_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    # Bytes split at the six white space characters of ASCII, and only A-Z are lowered.
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), SHINGLES):
        part = [
            digest(joined[a:b], SEED)
            for a, b in zip(starts[at : at + SHINGLES], ends[at : at + SHINGLES])
        ]
        bits = np.unpackbits(
            np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        counts += bits.sum(axis=0, dtype=np.int64)
    over = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(over.view("<u8")[0])


def fingerprints(docs: DataFrame, name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """The columns but ``text``, with the fingerprint as a signed number."""
    others = [c for c in docs.columns if c.lower() != "text"]
    frame = docs.select(*others, "text")
    kinds = ", ".join(
        f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in frame.schema[:-1]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(others)).cast(pa.binary())
            found = np.array([fingerprint(text.as_py(), shingle) for text in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*others, name]
            )

    return frame.mapInArrow(run, ", ".join(filter(None, [kinds, f"{name} bigint"])))


class AnchorCode:
    """The parts of a fingerprint and the Hamming code over each of them."""

    def __init__(self, distance: int = DISTANCE):
        self.parts = next(n for n in range(1, BITS + 1) if distance // n <= 1)
        self.reach = distance // self.parts
        self.width = BITS // self.parts
        checks = (self.width + 1).bit_length() - 1
        self.length = (1 << checks) - 1
        places = np.arange(1, self.length + 1, dtype=np.uint64)
        self.masks = [
            np.uint64(sum(1 << i for i, p in enumerate(places.tolist()) if p >> check & 1))
            for check in range(checks)
        ]
        # For each syndrome the pairs of places whose flips also lead to an anchor.
        self.pairs = np.zeros((self.length + 1, (self.length - 1) // 2), np.uint64)
        for syndrome in range(1, self.length + 1):
            flips = [
                (1 << a - 1) | (1 << (a ^ syndrome) - 1)
                for a in range(1, self.length + 1)
                if a < a ^ syndrome
            ]
            self.pairs[syndrome] = flips

    def word(self, points: np.ndarray, part: int) -> np.ndarray:
        """The bits of a part that the code covers; a bit left over takes no part in the key."""
        return (points >> np.uint64(part * self.width)) & np.uint64((1 << self.length) - 1)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        found = np.zeros(len(words), np.int64)
        for check, mask in enumerate(self.masks):
            found |= (np.bitwise_count(words & mask) & 1).astype(np.int64) << check
        return found

    def home(self, points: np.ndarray, part: int) -> np.ndarray:
        words = self.word(points, part)
        found = self.syndrome(words)
        flip = np.where(found > 0, np.uint64(1) << np.maximum(found - 1, 0).astype(np.uint64), 0)
        return words ^ flip.astype(np.uint64)

    def key(self, anchors: np.ndarray, part: int) -> np.ndarray:
        """Part and anchor in one number; scrambled, so that near anchors are dealt apart."""
        return ((np.uint64(part) << np.uint64(self.length)) | anchors) * np.uint64(
            0x9E3779B97F4A7C15
        )

    def replicas(self, points: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all anchors in reach, and the places of their points."""
        words = self.word(points, part)
        found = self.syndrome(words)
        home = self.key(self.home(points, part), part)
        places = np.arange(len(points))
        if not self.reach:
            return home, places
        off = np.flatnonzero(found)
        others = words[off, None] ^ self.pairs[found[off]]
        return (
            np.concatenate([home, self.key(others, part).ravel()]),
            np.concatenate([places, np.repeat(off, others.shape[1])]),
        )


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            name: pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)
            for name, x in columns.items()
        }
    )


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _within(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def run_links(home: np.ndarray, others: np.ndarray, distance: int) -> tuple[list, list]:
    """A forest that links the points at home, and these with the others, within the distance."""
    a, b = [], []
    root = np.arange(len(home))
    left = np.arange(len(home))
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        first = frontier[0]
        while frontier and len(left):
            point = frontier.pop()
            near = _within(home[left], home[point], distance)
            reached = left[near]
            if len(reached):
                a.append(np.full(len(reached), home[point]))
                b.append(home[reached])
                root[reached] = first
                frontier.extend(reached.tolist())
                left = left[~near]
    step = max(1, PAIRS // max(1, len(home)))
    for start in range(0, len(others), step):
        part = others[start : start + step]
        row, column = np.nonzero(_within(part[:, None], home[None, :], distance))
        # One link to each component of the points at home.
        keep = np.unique(row * len(home) + root[column], return_index=True)[1]
        a.append(home[column[keep]])
        b.append(part[row[keep]])
    return a, b


def _links(distance: int):
    """Links within runs of equal key and group, of rows sorted by these with those at home first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = (
                _unsigned(batch.column(0)),
                batch.column(1).to_numpy(zero_copy_only=False),
                batch.column(2).to_numpy(zero_copy_only=False).astype(bool),
                _unsigned(batch.column(3)),
            )
            if rest is not None:
                now = tuple(np.concatenate([x, y]) for x, y in zip(rest, now))
            key, group = now[0], now[1]
            if not len(key):
                continue
            # The last run may go on; of a long one the points at home are enough to go on with.
            same = (key == key[-1]) & (group == group[-1])
            cut = len(key) - int(np.argmin(same[::-1])) if not same.all() else 0
            ended = tuple(x[:cut] for x in now)
            rest = tuple(x[cut:] for x in now)
            yield from _of_runs(*ended, distance)
            if len(rest[0]) > 4 * HOME_POINTS:
                yield from _of_runs(*rest, distance)
                rest = tuple(x[rest[2]] for x in rest)
        if rest is not None:
            yield from _of_runs(*rest, distance)

    return run


def _of_runs(
    key: np.ndarray, group: np.ndarray, home: np.ndarray, point: np.ndarray, distance: int
) -> Iterator[pa.RecordBatch]:
    if len(key) < 2:
        return
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
    begin = np.flatnonzero(new)
    size = np.diff(np.concatenate([begin, [len(key)]]))
    # Points at home come first, so a run without one starts with a replica.
    useful = (size > 1) & home[begin]
    a, b = [], []
    for n in np.flatnonzero(useful & (size > SHORT_RUN)).tolist():
        part = slice(begin[n], begin[n] + size[n])
        at_home = home[part]
        x, y = run_links(point[part][at_home], point[part][~at_home], distance)
        a += x
        b += y
    short = np.repeat(useful & (size <= SHORT_RUN), size)
    last = np.repeat(begin + size, size)
    rows = np.flatnonzero(short)
    for shift in range(1, SHORT_RUN):
        rows = rows[rows + shift < last[rows]]
        if not len(rows):
            break
        near = rows[home[rows] & _within(point[rows], point[rows + shift], distance)]
        a.append(point[near])
        b.append(point[near + shift])
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield _batch(a=a, b=b)


def near_links(points: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct points ``fp`` within the distance: not all of them, but enough
    that the same points are connected."""
    code = AnchorCode(distance)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _unsigned(batch.column(0))
            for part in range(code.parts):
                yield _batch(key=code.key(code.home(found, part), part))

    def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _unsigned(batch.column(0))
            for part in range(code.parts):
                key, place = code.replicas(found, part)
                at_home = np.arange(len(key)) < len(found)
                yield _batch(key=key, home=at_home, fp=found[place])

    popular = written(
        points.select("fp")
        .mapInArrow(homes, "key bigint")
        .groupBy("key")
        .count()
        .where(F.col("count") > HOME_POINTS)
        .select("key", F.ceil(F.col("count") / HOME_POINTS).cast("int").alias("groups")),
        "simhash",
    )
    rows = points.select("fp").mapInArrow(replicas, "key bigint, home boolean, fp bigint")
    many = popular.count()
    if many:
        mine = F.pmod(F.xxhash64("fp"), F.col("groups")).cast("int")
        rows = (
            rows.join(small(popular, many), "key", "left")
            .withColumn(
                "group", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1))
            )
            .withColumn("home", F.col("home") & (F.col("group") == F.coalesce(mine, F.lit(0))))
        )
    else:
        rows = rows.withColumn("group", F.lit(0))
    sorted_rows = (
        rows.select("key", "group", "home", "fp")
        .repartition("key", "group")
        .sortWithinPartitions("key", "group", F.desc("home"))
    )
    return sorted_rows.mapInArrow(_links(distance), "a bigint, b bigint").distinct()


def _identity() -> Column:
    """128 bits of a document's id and text, without a null."""
    return F.struct(
        F.xxhash64("doc_id", "text").alias("x"), F.xxhash64("text", F.lit(1), "doc_id").alias("y")
    )


def components(digest: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp``, ``component_id`` and ``stays`` of every distinct fingerprint. ``digest`` has ``fp``,
    ``doc_id`` and ``identity``; ``stays`` is the identity of the document of the smallest id."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "identity")
    points = written(digest.groupBy("fp").agg(F.min(first).alias("first")), "simhash")
    roots = component_roots(near_links(points, distance))
    members = points.join(roots, points["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = members.groupBy("root").agg(F.min("first").alias("least"))
    return members.join(least, "root").select(
        "fp",
        F.col("least.doc_id").alias("component_id"),
        F.col("least.identity").alias("stays"),
    )


def _digest(docs: DataFrame, shingle: int) -> DataFrame:
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("identity", _identity())
    return written(fingerprints(rows, shingle=shingle), "simhash")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """doc_id, fingerprint in hexadecimal and component_id of every row."""
    digest = _digest(docs, shingle)
    return (
        digest.select("doc_id", "fp")
        .join(components(digest, distance), "fp")
        .select(
            "doc_id",
            F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
            "component_id",
        )
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The documents that stay, one of each component: that of the smallest id, or of several rows
    with that id the one whose identity sorts first; of rows equal in id and text, one.

    Most documents stay, so what leaves the table is the identities of those that go. While these
    are few they are broadcast, and no text is shuffled; more of them are joined.
    """
    digest = _digest(docs, shingle)
    found = written(
        digest.join(components(digest, distance), "fp")
        .groupBy(F.col("identity.x").alias("x"), F.col("identity.y").alias("y"))
        .agg(
            F.max(F.col("identity") == F.col("stays")).alias("stay"),
            F.count(F.lit(1)).alias("rows"),
        )
        .where(~F.col("stay") | (F.col("rows") > 1)),
        "simhash",
    )
    x, y = free_names(docs.columns, "x", "y")
    text, number = F.coalesce("text", F.lit("")), F.col("doc_id").cast("bigint")
    rows = docs.withColumn(x, F.xxhash64(number, text)).withColumn(
        y, F.xxhash64(text, F.lit(1), number)
    )

    def among(some: DataFrame) -> DataFrame:
        return small(some.select(F.col("x").alias(x), F.col("y").alias(y)), some.count())

    kept = rows.join(among(found), [x, y], "left_anti")
    repeated = found.where("stay")
    if repeated.take(1):
        kept = kept.unionAll(
            rows.join(among(repeated), [x, y], "left_semi").dropDuplicates([x, y])
        )
    return kept.select(*docs.columns)
