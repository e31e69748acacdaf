"""Byte-level BPE encoding and decoding.

Texts are split into slices without a regular expression: each code point has a class,
each class is a transition function of a small automaton, and since functions compose
associatively, the state in front of every code point comes from a scan by doubling
over all texts of a piece at once.  Each distinct slice is merged once per task; ids
are kept as little-endian unsigned 32-bit integers, and the bytes of a token and its
place follow from its id and the ids before it.

The split is that of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

NULL and empty texts have no ids.  Rows keep their other columns; a column named like a
new one is replaced.  Equal rows give equal rows.  A text of any length is one row's
work; a slice of any length is merged with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from blockprep.llm.common import Shared, built, utf8, with_columns

#: Slices whose ids a task remembers; then it starts to gather anew.
CACHE_SLICES = 150_000
#: A rank file is sent to every task, so it may not be larger.
MAX_RANK_BYTES = 64 << 20
#: Slices longer than this are merged with a heap.
HEAP_FROM = 256

LETTER, DIGIT, MARK, SPACE, BLANK = range(5)

# States: nothing that an apostrophe would join is open; a run of marks or a space is
# open; one or two letters of a contraction are still to come.
FREE, OPEN, ONE, TWO = range(4)


def _function(*to: int) -> int:
    """A transition function as a byte: two bits for the state that each state goes to."""
    return sum(state << (2 * i) for i, state in enumerate(to))


_LETTER = _function(FREE, FREE, FREE, ONE)
_OF_CLASS = np.array(
    [_LETTER, _function(FREE, FREE, FREE, FREE)] + [_function(OPEN, OPEN, OPEN, OPEN)] * 2 + [_function(FREE, FREE, FREE, FREE)],
    np.uint8,
)
_SHORT = _function(ONE, OPEN, ONE, ONE)
_LONG = _function(TWO, OPEN, TWO, TWO)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composition (second, first), functions that ignore the state before, and these made from FREE."""
    codes = np.arange(256)
    to = (codes[:, None] >> (2 * np.arange(4))) & 3
    both = to[np.arange(256)[:, None, None], to[None, :, :]]
    compose = (both << (2 * np.arange(4))).sum(axis=2).astype(np.uint8)
    constant = (to == to[:, :1]).all(axis=1)
    from_free = (to[:, :1] << (2 * np.arange(4))).sum(axis=1).astype(np.uint8)
    return compose, constant, from_free


_COMPOSE, _CONSTANT, _FROM_FREE = _tables()


def code_classes() -> np.ndarray:
    """The class of every code point, as the tokenizer library's own patterns have it.

    Unicode tables differ between libraries; asking the one whose results are to be
    matched keeps the split equal to its split.
    """
    import tiktoken

    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    classes = np.full(0x110000, MARK, np.uint8)
    for pattern, number in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", BLANK)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(probe.encode_ordinary(text)).decode("utf-8")
        classes[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = number
    classes[0x20] = SPACE
    return classes


def states_before(functions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state in front of each code point; ``first`` marks those that start a text."""
    scan = np.where(first, _FROM_FREE[functions], functions)
    reach = 1
    while len(open_ := np.flatnonzero(~_CONSTANT[scan])):
        scan[open_] = _COMPOSE[scan[open_], scan[open_ - reach]]
        reach *= 2
    before = np.zeros(len(scan), np.uint8)
    before[1:] = scan[:-1] & 3
    before[first] = FREE
    return before


def slice_starts(codes: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Which code points start a slice.  ``first`` marks those that start a text."""
    kind = classes[codes]
    functions = _OF_CLASS[kind]
    last = np.ones(len(codes), bool)
    last[:-1] = first[1:]
    marks = np.flatnonzero(codes == 0x27)
    if len(marks):
        padded = np.concatenate([codes, [0, 0]])
        ends = np.concatenate([last, [True, True]])
        one = np.where(ends[marks], 0, padded[marks + 1])
        two = np.where(ends[marks] | ends[marks + 1], 0, padded[marks + 2])
        pair = (one << 8) | two
        short, long = np.frombuffer(b"stmd", np.uint8), [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]
        functions[marks[np.isin(one, short)]] = _SHORT
        functions[marks[np.isin(pair, long)]] = _LONG
    before = states_before(functions, first)

    previous = np.full(len(codes), 255, np.uint8)
    previous[1:] = kind[:-1]
    blank, blank_before = kind >= SPACE, (previous == SPACE) | (previous == BLANK)
    next_blank = np.zeros(len(codes), bool)
    next_blank[:-1] = blank[1:]
    # The last blank of a run goes with what follows, if something follows.
    starts = np.where(blank, ~blank_before | ~(next_blank | last), (previous != kind) & (previous != SPACE))
    after = np.zeros(len(codes), bool)
    after[1:] = (before[:-1] == ONE) & (kind[:-1] == LETTER)
    starts |= after & ~blank
    starts &= ~((before == ONE) | (before == TWO)) | (kind != LETTER)
    return starts | first


class Ranks:
    """Token bytes by rank, merging, and the vocabulary as one byte array for decoding."""

    def __init__(self, lines: bytes) -> None:
        rows = [line.split() for line in lines.splitlines() if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in rows}
        size = max(self.rank.values(), default=-1) + 1
        words = [b""] * size
        for word, number in self.rank.items():
            words[number] = word
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.data = np.frombuffer(b"".join(words), np.uint8)

    def merge(self, word: bytes) -> bytes:
        """The ids of a slice, little-endian, unsigned, 32 bits each."""
        whole = self.rank.get(word)
        if whole is not None:
            return whole.to_bytes(4, "little")
        parts = self._merge_long(word) if len(word) > HEAP_FROM else self._merge_short(word)
        return struct.pack(f"<{len(parts)}I", *[self.rank[p] for p in parts])

    def _merge_short(self, word: bytes) -> list[bytes]:
        get, never = self.rank.get, len(self.length)
        at = list(range(len(word) + 1))
        pairs = [get(word[i : i + 2], never) for i in at[:-2]]
        while (least := min(pairs, default=never)) < never:
            i = pairs.index(least)
            del at[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(word[at[i] : at[i + 2]], never)
            if i:
                pairs[i - 1] = get(word[at[i - 1] : at[i + 1]], never)
        return [word[a:b] for a, b in zip(at, at[1:])]

    def _merge_long(self, word: bytes) -> list[bytes]:
        get, n = self.rank.get, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if end[i] < n and (r := get(word[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if middle <= i or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        parts, i = [], 0
        while i < n:
            parts.append(word[i : end[i]])
            i = end[i]
        return parts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and where each token ends in them."""
        length = self.length[ids]
        ends = np.cumsum(length)
        source = np.arange(ends[-1] if len(ends) else 0)
        source += np.repeat(self.start[ids] - (ends - length), length)
        return self.data[source], ends


class Cache(dict):
    """Ids of slices met before, ``slices`` at most."""

    def __init__(self, ranks: Ranks, slices: int = CACHE_SLICES) -> None:
        super().__init__()
        self.ranks, self.slices = ranks, slices

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.slices:
            self.clear()
        ids = self.ranks.merge(word)
        if len(word) <= HEAP_FROM:
            self[word] = ids
        return ids


def ranks_key(lines: bytes) -> str:
    return hashlib.sha256(lines).hexdigest()


def load(lines: bytes, slices: int = CACHE_SLICES) -> tuple[Ranks, Cache]:
    """A rank file ready for use, with an empty cache."""
    ranks = Ranks(lines)
    return ranks, Cache(ranks, slices)


def read_ranks(path: str) -> bytes:
    """A rank file (base64 of the token, its rank), read on the driver."""
    with open(path, "rb") as file:
        lines = file.read(MAX_RANK_BYTES + 1)
    if len(lines) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has more than {MAX_RANK_BYTES} bytes")
    return lines


def encode_piece(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, cache: Cache) -> list[bytes]:
    """The ids of each row."""
    raw = data.tobytes()
    codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    places = np.flatnonzero((data & 0xC0) != 0x80)
    rows = np.searchsorted(places, offsets)
    first = np.zeros(len(codes), bool)
    first[rows[:-1][rows[:-1] < len(codes)]] = True
    cut = np.flatnonzero(slice_starts(codes, first, classes)) if len(codes) else np.empty(0, np.int64)
    bounds = np.searchsorted(cut, rows).tolist()
    cuts = [*places[cut].tolist(), len(raw)]
    ids = [cache[raw[a:b]] for a, b in zip(cuts, cuts[1:])]
    return [b"".join(ids[a:b]) for a, b in zip(bounds, bounds[1:])]


def _shared(spark: SparkSession, path: str) -> Shared:
    lines = read_ranks(path)
    return Shared(spark, lines, ranks_key(lines))


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids", slices: int | None = None) -> DataFrame:
    """Add the ids of each text as binary: little-endian unsigned 32-bit integers.

    ``path`` is a rank file on the driver; it and the code point classes (1.1 MB) are
    broadcast.  A worker keeps its encoder for later tasks; with ``slices``, each task has its
    own, which remembers so many slices and is let go at the task's end.
    """
    ranks = _shared(df.sparkSession, path)
    classes = df.sparkSession.sparkContext.broadcast(code_classes().tobytes())

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        cache = built(ranks, load)[1] if slices is None else load(ranks.value, slices)[1]
        table = np.frombuffer(classes.value, np.uint8)

        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            data, offsets = utf8(piece.column(text))
            return [pa.array(encode_piece(data, offsets, table, cache), pa.binary())]

        return work

    return with_columns(df, text, [(into, "binary")], make)


def decode(
    df: DataFrame, path: str, ids: str = "ids", into: str = "decoded", ends: str | None = None
) -> DataFrame:
    """Add the bytes of each row's ids; with ``ends``, also the byte at which each token ends.

    NULL ids give no bytes.  An id that the file does not have gives no bytes either.
    """
    shared = _shared(df.sparkSession, path)
    fields = [(into, "binary")] + ([(ends, "array<long>")] if ends else [])

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        ranks = built(shared, load)[0]
        known = len(ranks.length)

        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            texts, places = [], []
            for blob in piece.column(ids).to_pylist():
                numbers = np.frombuffer(blob or b"", "<u4").astype(np.int64)
                data, at = ranks.decode(numbers[numbers < known])
                texts.append(data.tobytes())
                if ends:
                    places.append(at)
            return [pa.array(texts, pa.binary())] + ([pa.array(places, pa.list_(pa.int64()))] if ends else [])

        return work

    return with_columns(df, ids, fields, make)
