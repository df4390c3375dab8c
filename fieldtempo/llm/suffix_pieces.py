"""SentencePiece encoding and decoding by matching the vocabulary against a suffix array.

The distinct stretches of a batch of texts are joined to one text, and its suffixes are sorted as far
as the longest piece reaches. Every piece of the vocabulary is looked up there by binary search; the
range of suffixes that begin with it are its occurrences. They are the edges of the segmentation
lattice, sorted by position, and relaxed in the order the model sets: this vocabulary is of merges,
so in each stretch the edge of the best score that spans two neighbouring symbols joins them, the
leftmost of equal ones first, until none is left. The ids are those of the SentencePiece library.

A stretch ends before a space that follows something else, and around characters that are part of no
longer piece: no piece crosses such a place, so stretches are independent and each is encoded once,
however often it occurs. Long stretches, as in languages written without spaces, are also cut between
characters that are neighbours in no piece, and relaxed apart wherever no occurrence reaches across.
Characters that are no piece become the pieces of their bytes.

Null text is encoded as empty; an empty text has no pieces. Decoding gives the text back, but for
the mark that stands for a space, which comes back as a space. Copies and repeated rows give a row
each; an empty table gives no rows. Further columns are not touched.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtempo.llm.batches import parts, releasing
from fieldtempo.llm.pieces import SPACE, VOCABULARY, vocabulary

#: Bytes of text taken at a time, distinct stretches that a worker remembers, and characters relaxed
#: at a time. A worker keeps what it remembers while it runs the tasks of other stages.
BATCH = 1_000_000
REMEMBERED = 400_000
CHUNK = 250_000
#: Longer stretches are relaxed one by one, with a heap.
LONG = 64


class SuffixIndex:
    """The suffixes of a text of code numbers, sorted by their first ``depth`` characters."""

    def __init__(self, codes: np.ndarray, depth: int):
        self.alphabet = np.unique(codes)
        dense = np.searchsorted(self.alphabet, codes).astype(np.uint64) + np.uint64(1)
        self.bits = max(1, int(len(self.alphabet) + 1).bit_length())
        self.width = 64 // self.bits
        self.keys = []
        padded = np.concatenate([dense, np.zeros(depth + self.width, np.uint64)])
        for start in range(0, depth, self.width):
            key = np.zeros(len(codes), np.uint64)
            for at in range(start, start + self.width):
                key = (key << np.uint64(self.bits)) | padded[at : at + len(codes)]
            self.keys.append(key)
        # Ranks of the first characters, then of those and the next ones, and so on.
        self.levels = []
        rank = None
        for key in self.keys:
            values, place, order = self._ranked(key)
            if rank is None:
                ranks, rank = np.arange(len(values), dtype=np.uint64), place
            else:
                ranks, rank, order = self._ranked(rank * np.uint64(len(values) + 1) + place)
            self.levels.append((values, ranks))
        self.order = order
        self.sorted = rank[order]

    @staticmethod
    def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, the place of each key among them, and the order of the keys."""
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        place = np.empty(len(keys), np.uint64)
        place[order] = np.cumsum(new).astype(np.uint64) - np.uint64(1)
        return ordered[new], place, order

    def ranges(self, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, padded with -1 to the depth, the range of ``order`` that begins with it."""
        dense = np.searchsorted(self.alphabet, np.maximum(pieces, 0))
        dense = np.minimum(dense, len(self.alphabet) - 1)
        inside = np.arange(pieces.shape[1]) < lengths[:, None]
        known = ((self.alphabet[dense] == pieces) | ~inside).all(axis=1)
        low = np.zeros(len(pieces), np.uint64)
        high = np.zeros(len(pieces), np.uint64)
        alive = known.copy()
        top = np.uint64((1 << self.bits) - 1)
        for level, (values, ranks) in enumerate(self.levels):
            least = np.zeros(len(pieces), np.uint64)
            most = np.zeros(len(pieces), np.uint64)
            for at in range(level * self.width, (level + 1) * self.width):
                if at < pieces.shape[1]:
                    code = np.where(inside[:, at], dense[:, at].astype(np.uint64) + np.uint64(1), 0)
                    last = np.where(inside[:, at], code, top)
                else:
                    code, last = np.zeros(len(pieces), np.uint64), np.full(len(pieces), top)
                least = (least << np.uint64(self.bits)) | code.astype(np.uint64)
                most = (most << np.uint64(self.bits)) | last.astype(np.uint64)
            factor = np.uint64(len(values) + 1)
            first = np.searchsorted(values, least, "left").astype(np.uint64)
            behind = np.searchsorted(values, most, "right").astype(np.uint64)
            # low and high - 1 are the first and last rank that match so far.
            low, high = (
                np.searchsorted(ranks, low * factor + first, "left").astype(np.uint64),
                np.searchsorted(
                    ranks, (np.maximum(high, 1) - np.uint64(1)) * factor + behind, "left"
                ).astype(np.uint64)
                if level
                else np.searchsorted(ranks, behind, "left").astype(np.uint64),
            )
            alive &= high > low
        begin = np.searchsorted(self.sorted, low, "left")
        end = np.searchsorted(self.sorted, high, "left")
        return np.where(alive, begin, 0), np.where(alive, end, 0)


class Encoder:
    """Encodes stretches, and remembers what it has encoded."""

    def __init__(self, path: str = VOCABULARY):
        self.vocabulary = vocabulary(path)
        pieces = self.vocabulary.pieces
        self.depth = max(map(len, pieces))
        self.lengths = np.array([len(piece) for piece in pieces])
        self.codes = np.full((len(pieces), self.depth), -1, np.int64)
        for n, piece in enumerate(pieces):
            self.codes[n, : len(piece)] = [ord(c) for c in piece]
        self.ids = np.array(self.vocabulary.ids)
        # Place of each piece in the order of merging; equal scores are equal places.
        self.priority = np.unique(-np.array(self.vocabulary.scores), return_inverse=True)[1]
        joined = {c for piece in pieces if len(piece) > 1 for c in piece}
        lone = "".join(re.escape(chr(n)) for n in range(128) if n != 32 and chr(n) not in joined)
        crossing = any(SPACE in piece.lstrip(SPACE) for piece in pieces)
        self.stretch = re.compile(f"[{lone}]| *[^ {lone}]+| +" if lone else " *[^ ]+| +")
        pairs = {(ord(a), ord(b)) for piece in pieces for a, b in zip(piece, piece[1:])}
        self.pairs = np.array(sorted(a << 32 | b for a, b in pairs), np.int64)
        if crossing:
            self.stretch = re.compile(r"[\s\S]+")
        self.forget()

    def forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict(count().__next__)
        self.values = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and end among them."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known, before = self.known, len(self.known)
        split = self._stretches
        numbers = [
            [known[x] for x in split(" " + text.replace(SPACE, " "))] if text else []
            for text in texts
        ]
        if len(known) > before:
            self._learn(list(known)[before:])
        per_text = np.array([len(x) for x in numbers], np.int64)
        flat = np.fromiter((n for x in numbers for n in x), np.int64, int(per_text.sum()))
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        place = np.arange(int(sizes.sum())) + np.repeat(self.starts[flat] - (ends - sizes), sizes)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return self.values[place], bounds

    def _stretches(self, text: str) -> list[str]:
        found = self.stretch.findall(text)
        if max(map(len, found)) <= LONG:
            return found
        return [part for x in found for part in (self._cut(x) if len(x) > LONG else (x,))]

    def _cut(self, text: str) -> list[str]:
        """The parts of a long stretch between characters that are neighbours in no piece."""
        codes = np.frombuffer(text.replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = codes[:-1] << 32 | codes[1:]
        place = np.minimum(np.searchsorted(self.pairs, pairs), max(0, len(self.pairs) - 1))
        apart = self.pairs[place] != pairs if len(self.pairs) else np.ones(len(pairs), bool)
        cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, stretches: list[str]) -> None:
        """Appends the ids of new stretches, shorter ones first."""
        order = np.argsort(np.array([len(x) for x in stretches]), kind="stable")
        values, sizes, held, size = [self.values], [], [], 0
        for n in order.tolist():
            held.append(stretches[n])
            size += len(stretches[n]) + 1
            if size >= CHUNK:
                self._chunk(held, values, sizes)
                held, size = [], 0
        if held:
            self._chunk(held, values, sizes)
        known = len(self.values)
        self.values = np.concatenate(values)
        by_order = np.concatenate(sizes)
        own = np.empty((2, len(stretches)), np.int64)
        own[:, order] = by_order, known + np.cumsum(by_order) - by_order
        self.sizes = np.concatenate([self.sizes, own[0]])
        self.starts = np.concatenate([self.starts, own[1]])

    def _chunk(self, stretches: list[str], values: list, sizes: list) -> None:
        """Appends the ids of some stretches, one after the other, and how many each has."""
        lengths = np.array([len(x) for x in stretches])
        # Each stretch is followed by a character that is in no piece.
        text = ("\0".join(stretches) + "\0").replace(" ", SPACE)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(lengths + 1) - lengths - 1
        owner = np.repeat(np.arange(len(stretches)), lengths + 1)
        separator = first + lengths
        codes[separator] = 0x110000
        start, end, piece = self._edges(codes)
        bounds = self._relax(start, end, piece, len(codes))
        # Symbols run from one boundary to the next; those that are pieces have an edge.
        nodes = np.flatnonzero(bounds)
        begin, finish = nodes[:-1], nodes[1:]
        real = begin < separator[owner[begin]]
        begin, finish = begin[real], finish[real]
        key = start * 64 + (end - start)
        by_key = np.argsort(key)
        wanted = begin * 64 + (finish - begin)
        place = np.minimum(np.searchsorted(key[by_key], wanted), max(0, len(key) - 1))
        symbol = np.full(len(begin), -1, np.int32)
        if len(key):
            hit = key[by_key][place] == wanted
            symbol[hit] = self.ids[piece[by_key[place[hit]]]]
        of = owner[begin]
        cuts = np.searchsorted(of, np.arange(len(stretches) + 1))
        counts, done = np.diff(cuts), 0
        for n in np.unique(of[symbol < 0]).tolist():
            part = slice(cuts[n], cuts[n + 1])
            ids = self._with_bytes(symbol[part], text, begin[part])
            values += [symbol[done : cuts[n]], ids]
            done, counts[n] = cuts[n + 1], len(ids)
        values.append(symbol[done:])
        sizes.append(counts)

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of all occurrences, by position."""
        index = SuffixIndex(codes, self.depth)
        low, high = index.ranges(self.codes, self.lengths)
        sizes = high - low
        piece = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = index.order[np.repeat(low, sizes) + within]
        by_position = np.argsort(start, kind="stable")
        start, piece = start[by_position], piece[by_position]
        return start, start + self.lengths[piece], piece

    def _relax(self, start, end, piece, size) -> np.ndarray:
        """Which places are boundaries of symbols once all merges are made."""
        bounds = np.ones(size + 1, bool)
        longer = (end - start) > 1
        s, e, rank = start[longer], end[longer], self.priority[piece[longer]]
        # Parts end where no occurrence reaches across, so no merge does.
        reach = np.bincount(s + 1, minlength=size + 2) - np.bincount(e, minlength=size + 2)
        first = np.flatnonzero(np.cumsum(reach)[:size] == 0)
        lengths = np.diff(np.append(first, size))
        own = np.repeat(np.arange(len(first)), lengths)[s]
        short = lengths[own] <= LONG
        # Occurrences are in the order of their starts, so those of a part stand together.
        for n in np.unique(own[~short]).tolist():
            low, high = np.searchsorted(own, (n, n + 1))
            mine = slice(low, high)
            self._merge_long(s[mine], e[mine], rank[mine], int(first[n]), int(lengths[n]), bounds)
        s, e, rank, own = s[short], e[short], rank[short], own[short]
        order = np.lexsort((s, rank, own))
        s, e, own = s[order], e[order], own[order]
        while len(s):
            number = np.cumsum(bounds)
            inside = number[e] - number[s]
            live = bounds[s] & bounds[e] & (inside >= 2)
            s, e, own, inside = s[live], e[live], own[live], inside[live]
            ready = np.flatnonzero(inside == 2)
            if not len(ready):
                break
            # The first of each stretch is its best.
            best = ready[np.concatenate([[True], own[ready][1:] != own[ready][:-1]])]
            places = np.flatnonzero(bounds)
            bounds[places[number[s[best]]]] = False
        return bounds

    @staticmethod
    def _merge_long(s, e, rank, first, length, bounds) -> None:
        """The same for one part, in time nearly proportional to its length."""
        # The rank of an occurrence by its start and length; merged symbols keep that of their first
        # character, and where they end.
        ranks = np.full((length, int((e - s).max()) + 1), -1, np.int32)
        ranks[s - first, e - s] = rank
        rank_of, width = ranks.ravel().data, ranks.shape[1]
        after = array("q", range(1, length + 1))
        before = array("q", range(-1, length))
        two = np.flatnonzero(e - s == 2)
        # One number for each possible merge: rank, start, length of the first and of both symbols.
        heap = ((rank[two].astype(object) << 56) | ((s[two] - first).astype(object) << 16) | (1 << 8 | 2)).tolist()
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            a, whole = (top >> 16) & 0xFFFFFFFFFF, top & 0xFF
            middle, b = a + (top >> 8 & 0xFF), a + whole
            # The symbols may have been merged with others since.
            if after[a] != middle or middle >= length or after[middle] != b:
                continue
            bounds[first + middle] = False
            after[a] = b
            after[middle] = -1
            if b < length:
                before[b] = a
            left = before[a]
            if left >= 0 and b - left < width and (r := rank_of[left * width + b - left]) >= 0:
                heapq.heappush(heap, r << 56 | left << 16 | (a - left) << 8 | (b - left))
            if b < length and (right := after[b]) - a < width and (r := rank_of[a * width + right - a]) >= 0:
                heapq.heappush(heap, r << 56 | a << 16 | whole << 8 | (right - a))

    def _with_bytes(self, ids: np.ndarray, text: str, begin: np.ndarray) -> np.ndarray:
        out: list[int] = []
        for n, at in zip(ids.tolist(), begin.tolist()):
            if n >= 0:
                out.append(n)
            elif self.vocabulary.bytes:
                out.extend(self.vocabulary.bytes[b] for b in text[at].encode("utf-8"))
            else:
                out.append(self.vocabulary.unknown)
        return np.array(out, np.int32)


@lru_cache(maxsize=1)
def worker_encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of a Python worker, which runs many tasks: a stretch that one task has encoded
    is known to the next."""
    return Encoder(path)


@lru_cache(maxsize=2)
def token_bytes(path: str = VOCABULARY) -> tuple[bytes, ...]:
    """What each id stands for; nothing for control pieces."""
    known = vocabulary(path)
    table = [b""] * (1 + max((*known.ids, *known.bytes, known.unknown)))
    for piece, n in zip(known.pieces, known.ids):
        table[n] = piece.replace(SPACE, " ").encode("utf-8")
    for value, n in enumerate(known.bytes):
        table[n] = bytes([value])
    return tuple(table)


def decode_ids(ids: list[int] | None, path: str = VOCABULARY) -> str:
    """The text of some ids; bytes that are no UTF-8 become replacement characters."""
    table = token_bytes(path)
    text = b"".join([table[n] for n in ids or ()]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, path: str = VOCABULARY, check: bool = False) -> DataFrame:
    """The columns but ``text``, with ``ids``; with ``check`` also ``round_trip``, whether decoding
    the ids gives the text again."""
    others = [name for name in docs.columns if name.lower() != "text"]
    frame = docs.select(*others, "text")
    kinds = ", ".join(
        f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in frame.schema[:-1]
    )
    schema = ", ".join(filter(None, [kinds, "ids array<int>", "round_trip boolean" * check]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            for part in parts(batch, len(others), BATCH):
                texts = part.column(len(others)).to_pylist()
                values, bounds = encoder.encode(texts)
                ids = pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), pa.array(values, pa.int32())
                )
                columns = [*part.columns[:-1], ids]
                if check:
                    cuts, flat = bounds.tolist(), values.tolist()
                    columns.append(
                        pa.array(
                            [
                                decode_ids(flat[a:b], path) == (text or "").replace(SPACE, " ")
                                for a, b, text in zip(cuts, cuts[1:], texts)
                            ],
                            pa.bool_(),
                        )
                    )
                names = [*others, "ids", *["round_trip"] * check]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return frame.mapInArrow(releasing(run), schema)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The columns but ``ids``, with the ``text`` they stand for; null ids give an empty text."""
    others = [name for name in encoded.columns if name.lower() not in ("ids", "text")]
    frame = encoded.select(*others, F.col("ids").cast("array<int>"))
    kinds = ", ".join(
        f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in frame.schema[:-1]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(ids, path) for ids in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string())], names=[*others, "text"]
            )

    return frame.mapInArrow(run, ", ".join(filter(None, [kinds, "text string"])))
