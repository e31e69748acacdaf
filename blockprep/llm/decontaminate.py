"""Benchmark decontamination: one automaton over all windows of the test items.

Texts are normalised to lower-case words.  Every run of ``window`` consecutive words of an
item is a pattern, and so is an item that has fewer words.  One Aho-Corasick automaton holds
all patterns; each text is scanned once, and hits are mapped back to words and to places in
the original text.

NULL texts have no words and no hits.  Items without words are never found.  Items that
occur twice, or under a NULL id, mark words like others; ids are listed once, NULL never.
Any length of text is scanned whole.  Columns named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprep.llm.common import (
    LOWER,
    MARK_BYTES,
    Shared,
    built,
    count_and_bytes,
    letters_in,
    spans,
    utf8,
    with_columns,
)

#: Bytes of item text in one automaton, which every task holds (about 150 times that in
#: memory).  A larger benchmark is split, and texts are scanned once for each part.
PART_BYTES = 1 << 20

_NORMAL = bytes(0x20 if c in MARK_BYTES else LOWER[c] for c in range(256))
_LETTERS = letters_in(MARK_BYTES)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def patterns_of(items: list[tuple[str | None, bytes]], window: int) -> dict[bytes, tuple[int, list[str]]]:
    """Normalised windows with their number of words and the ids of the items they are in."""
    found: dict[bytes, tuple[int, set]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            pattern = b" " + b" ".join(words[i : i + size]) + b" "
            found.setdefault(pattern, (size, set()))[1].update([item] if item is not None else [])
    return {pattern: (size, sorted(ids)) for pattern, (size, ids) in found.items()}


def _automaton(patterns: dict[bytes, tuple[int, list[str]]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for pattern, (size, ids) in patterns.items():
        automaton.add_word(pattern.decode("latin-1"), (len(pattern), size, ids))
    automaton.make_automaton()
    return automaton


def scan(text: bytes, automaton: ahocorasick.Automaton) -> tuple[int, np.ndarray | None, set[str]]:
    """Number of words, which of them are hit (None: no word), and the ids of the items found."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), None, set()
    joined = b" " + b" ".join(words) + b" "
    hits = list(automaton.iter(joined.decode("latin-1")))
    if not hits:
        return len(words), None, set()
    gaps = np.cumsum(np.frombuffer(joined, np.uint8) == 0x20)
    edges, found = np.zeros(len(words) + 1, np.int64), set()
    for end, (length, size, ids) in hits:
        first = gaps[end - length + 1] - 1
        edges[first] += 1
        edges[first + size] -= 1
        found.update(ids)
    return len(words), np.cumsum(edges[:-1]) > 0, found


def hit_spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as character places (start, end) of the original text."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(data)]), _LETTERS)
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
    return [
        {"start": int(a), "end": int(b)} for a, b in zip(letters[starts[first]], letters[ends[last]])
    ]


def mark_contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``hit_items`` (ids as text) and ``hit_spans`` (characters)."""
    spark = docs.sparkSession
    parts = max(1, -(-count_and_bytes(items, item_text)[1] // part_bytes))
    chosen = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    marked = docs
    for number in range(parts):
        rows = chosen.where(part == number).where(F.col("t").isNotNull()).collect()
        table = patterns_of([(row["i"], row["t"].encode()) for row in rows], window)
        marked = _scan_part(marked, Shared(spark, table), text, number > 0)
    return marked


FIELDS = [
    ("n_words", "long"),
    ("n_hit", "long"),
    ("hit_items", "array<string>"),
    ("hit_spans", "array<struct<start: long, end: long>>"),
]


def _scan_part(df: DataFrame, shared, text: str, further: bool) -> DataFrame:
    """Scan against one part; ``further``: add to the hits of the parts before."""
    kept = [name for name in df.columns if further or name.lower() not in {n for n, _ in FIELDS}]
    df = df.select(*[F.col(f"`{name}`") for name in kept])
    if further:
        df = df.withColumnRenamed("hit_items", "_items").withColumnRenamed("hit_spans", "_spans")

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        automaton = built(shared, _automaton)

        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            data, offsets = utf8(piece.column(text))
            raw, at = data.tobytes(), offsets.tolist()
            before = piece.column("_spans").to_pylist() if further else [()] * piece.num_rows
            known = piece.column("_items").to_pylist() if further else [()] * piece.num_rows
            out = [], [], [], []
            for a, b, old, ids in zip(at, at[1:], before, known):
                n, hit, found = scan(raw[a:b], automaton)
                if old:
                    hit = _old_hits(raw[a:b], old, n) | (False if hit is None else hit)
                out[0].append(n)
                out[1].append(0 if hit is None else int(hit.sum()))
                out[2].append(sorted(found.union(ids)))
                out[3].append([] if hit is None else hit_spans(raw[a:b], hit))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), _SPANS]
            return [pa.array(values, kind) for values, kind in zip(out, kinds)]

        return work

    return with_columns(df, text, FIELDS, make, without=("_items", "_spans") if further else ())


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _old_hits(text: bytes, old: list[dict[str, int]], words: int) -> np.ndarray:
    """Which words lie in spans found before."""
    data = np.frombuffer(text, np.uint8)
    starts, _, _ = spans(data, np.array([0, len(data)]), _LETTERS)
    letters = np.cumsum((data & 0xC0) != 0x80) - 1
    edges = np.zeros(words + 1, np.int64)
    for span in old:
        first, last = np.searchsorted(letters[starts], [span["start"], span["end"]])
        edges[first] += 1
        edges[last] -= 1
    return np.cumsum(edges[:-1]) > 0
