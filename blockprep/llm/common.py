"""Text columns as byte arrays: pieces of bounded size, word spans, hashes of spans.

Inside a task a text column of an Arrow batch is one byte array with the places
where its rows start, so that splitting and hashing are array work over many rows.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text worked on at once.  A row longer than this is a piece of its own.
PIECE_BYTES = 1 << 21
#: Bytes hashed at once; a longer span is hashed on its own.
HASH_BYTES = 1 << 20

# White space, and ASCII that belongs to no word.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
MARK_BYTES = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

#: Lower case for A-Z alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x5851F42D4C957F2D
_powers: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the place of each row in them; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each piece is at most ``limit`` bytes, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def letters_in(outside: bytes) -> np.ndarray:
    """A table: is this byte part of a word?"""
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


def spans(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the number of words before it.

    ``inside`` tells which bytes words are made of; no word crosses rows.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & ~(before & ~edge[:-1]))
    ends = np.flatnonzero(word & ~(after & ~edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = values + _ODD
    values = (values ^ (values >> np.uint64(30))) * _M1
    values = (values ^ (values >> np.uint64(27))) * _M2
    return values ^ (values >> np.uint64(31))


def byte_values(fold: bytes = bytes(range(256))) -> np.ndarray:
    """A 64-bit number for each byte; ``fold`` maps bytes that count as equal."""
    return mix(np.frombuffer(fold, np.uint8).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, HASH_BYTES + 1), base, np.uint64)
        have[0] = 1
        _powers[kind] = have = np.cumprod(have)
    return have[:n]


def hash_spans(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray
) -> np.ndarray:
    """A 64-bit hash of each span (sorted, not overlapping), from its bytes alone."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + HASH_BYTES, "right")))
        size = int(ends[last - 1] - low)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(values[data[low : low + size]] * _power("up", _STEP, size), out=total[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        down = _power("down", pow(_STEP, -1, 1 << 64), size)
        out[first:last] = (total[e] - total[s]) * down[s]
        first = last
    return mix(out ^ ((ends - starts).astype(np.uint64) * _M1))


def with_columns(
    df: DataFrame,
    text: str,
    fields: list[tuple[str, str]],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    without: tuple[str, ...] = (),
) -> DataFrame:
    """Add columns computed from pieces of a text or binary column.

    ``make`` is called once per task and gives a function from a piece to the new
    columns.  A column that already has a new column's name is replaced; those in
    ``without`` are read, but left out of the result.
    """
    gone = {name.lower() for name, _ in fields} | {name.lower() for name in without}
    kept = [field for field in df.schema.fields if field.name.lower() not in gone]
    names = [field.name for field in kept]
    schema = T.StructType(kept)
    for name, kind in fields:
        schema = schema.add(name, T.DataType.fromDDL(kind))
    titles = [field.name for field in schema.fields]
    used = df.select(*[F.col(f"`{n}`") for n in dict.fromkeys([*names, text, *without])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for piece in pieces(batches, text):
            arrays = [piece.column(name) for name in names] + work(piece)
            yield pa.RecordBatch.from_arrays(arrays, titles)

    return used.mapInArrow(run, schema)


def strings(values: list[bytes | None]) -> pa.Array:
    """UTF-8 byte strings as a text column."""
    return pa.array(values, pa.binary()).cast(pa.string())


def count_and_bytes(df: DataFrame, text: str) -> tuple[int, int]:
    """Rows, and bytes of text with one more for each row."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def parts_of(spark: SparkSession, total: int, limit: int) -> int:
    """Parts of at most about ``limit``, and no fewer than Spark's shuffle partitions."""
    return max(-(-total // limit), int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


class Shared:
    """A broadcast value, and a key by which a worker keeps what it built from it."""

    def __init__(self, spark: SparkSession, value: object, key: str | None = None) -> None:
        self.key = key or uuid.uuid4().hex
        self._broadcast = spark.sparkContext.broadcast(value)

    @property
    def value(self) -> object:
        return self._broadcast.value


_built: dict[str, object] = {}


def built(shared: Shared, build: Callable[[object], object]) -> object:
    """``build(value)``, made once per Python worker; the one before it is let go."""
    if shared.key not in _built:
        _built.clear()
        _built[shared.key] = build(shared.value)
    return _built[shared.key]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more.

    It does so when the driver collects garbage, which may be long after a loop has gone
    through many rounds, each with files of its own.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
