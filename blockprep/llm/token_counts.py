"""Token counts of sections: texts are encoded once, tokens are given to sections by place.

A document is encoded whole, so that a section's count is what it takes of the document's
tokens and not what it would take alone.  Every token has a span of characters; sections are
spans too.  Tokens and sections meet in an interval join: both are sorted, so that a binary
search finds the sections that a token touches.  A token within one section is its; one that
crosses a boundary goes to the section that holds most of its characters, of equal ones the
first.  A character that is several tokens counts for the token that begins it; tokens
without a beginning character go where that character goes.

Sections are the lines of a text, newlines belonging to the line that they end.  NULL and
empty texts have no tokens and no sections, and stay as rows.  Equal rows give equal rows, an
empty table gives none.  Columns named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprep.llm import bpe
from blockprep.llm.common import Shared, built, utf8, with_columns


def line_starts(data: np.ndarray) -> np.ndarray:
    """The characters at which lines begin; a newline ends its line."""
    places = np.flatnonzero((data & 0xC0) != 0x80)
    new = np.flatnonzero(data[places] == 0x0A) + 1
    return np.concatenate([[0], new[new < len(places)]]) if len(places) else np.empty(0, np.int64)


def token_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens that end at these bytes; a part of a character has its span."""
    letter = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte, its character
    first = np.concatenate([[0], ends[:-1]])
    return letter[first], letter[ends - 1] + 1


def owners(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, length: int) -> np.ndarray:
    """Of each token span the section that it goes to; sections begin at ``sections``."""
    stops = np.append(sections[1:], length)
    low = np.searchsorted(sections, starts, "right") - 1
    high = np.searchsorted(sections, ends - 1, "right") - 1
    best, most = low.copy(), np.minimum(stops[low], ends) - starts
    for step in range(1, int((high - low).max(initial=0)) + 1):
        crossing = np.flatnonzero(low + step <= high)
        section = low[crossing] + step
        share = np.minimum(stops[section], ends[crossing]) - sections[section]
        more = share > most[crossing]
        best[crossing[more]], most[crossing[more]] = section[more], share[more]
    return best


_COUNTS = pa.list_(
    pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])
)


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` and ``sections``: spans of characters with their tokens.

    ``n_crossing`` of a section are the tokens among its own that also touch others.
    """
    lines = bpe.read_ranks(path)
    ranks = Shared(docs.sparkSession, lines, bpe.ranks_key(lines))
    classes = docs.sparkSession.sparkContext.broadcast(bpe.code_classes().tobytes())

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        known, cache = built(ranks, bpe.load)
        table = np.frombuffer(classes.value, np.uint8)

        def one(data: np.ndarray, ids: np.ndarray) -> list[dict[str, int]]:
            if not len(ids):
                return []
            starts, ends = token_spans(data, np.cumsum(known.length[ids]))
            sections = line_starts(data)
            length = int(((data & 0xC0) != 0x80).sum())
            owner = owners(starts, ends, sections, length)
            stops = np.append(sections[1:], length)
            crossing = (starts < sections[owner]) | (ends > stops[owner])
            counts = np.bincount(owner, minlength=len(sections)), np.bincount(owner, crossing, len(sections))
            columns = sections, stops, counts[0], counts[1].astype(np.int64)
            return [dict(zip(("start", "end", "n_tokens", "n_crossing"), row)) for row in zip(*(c.tolist() for c in columns))]

        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            data, offsets = utf8(piece.column(text))
            blobs = bpe.encode_piece(data, offsets, table, cache)
            counted = [
                one(data[a:b], np.frombuffer(blob, "<u4").astype(np.int64))
                for a, b, blob in zip(offsets, offsets[1:], blobs)
            ]
            return [pa.array([len(b) // 4 for b in blobs], pa.int64()), pa.array(counted, _COUNTS)]

        return work

    kind = "array<struct<start: long, end: long, n_tokens: long, n_crossing: long>>"
    return with_columns(docs, text, [("n_tokens", "long"), ("sections", kind)], make)


def section_rows(counted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per section: id, number from 0, span, tokens, and the tokens of the document.

    A document without sections is one row with no number and no span, and no tokens.
    """
    rows = counted.select(
        F.col(f"`{doc_id}`"), F.col("n_tokens").alias("doc_tokens"), F.posexplode_outer("sections").alias("section", "s")
    )
    none = F.lit(0).cast("long")
    return rows.select(
        f"`{doc_id}`",
        F.col("section").cast("long").alias("section"),
        "s.start",
        "s.end",
        F.coalesce("s.n_tokens", none).alias("n_tokens"),
        F.coalesce("s.n_crossing", none).alias("n_crossing"),
        "doc_tokens",
    )
