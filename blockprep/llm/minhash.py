"""MinHash near-duplicate classes over five-word shingles.

Each document's set of shingle hashes is split into bins by one permutation; a bin's value
is its least hash, and empty bins copy the bin that a fixed sequence of draws finds first
among the filled ones (optimal densification).  Bands of bins are buckets.  In a bucket only
star-shaped candidates are made: its first documents against the others, never all pairs.
Candidates are confirmed on the full sets, and links give components.  A bucket whose
documents are not yet one component goes on: its documents get new, exact buckets from their
rarest shingles, and rounds with more centres follow until every two documents of a bucket
are compared or known to be in one component.

Documents with equal sets are one class from the start; only the class with its least id
takes part.

NULL and empty texts, and texts without words, have an empty set and are linked with
nothing.  A text of fewer than five words is one shingle.  Documents without an id are
linked with nothing and have no component.  Rows equal in id and text are one document; where
rows share an id but not the text, each text is a document of its own.  An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockprep.llm.common import (
    LOWER,
    SPACE_BYTES,
    byte_values,
    hash_spans,
    letters_in,
    mix,
    release,
    spans,
    utf8,
    with_columns,
)
from blockprep.llm.components import stars
from blockprep.sources.storage import cut_lineage

WORDS = 5
#: Bins, and bins in a band: a pair of similarity 0.75 shares no band once in 200,000 times.
BINS, BAND = 128, 4
BANDS = BINS // BAND
_BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
#: Centres of a bucket in the first and in later rounds.
CENTRES = (1, 16, 256, 4096)
#: So many ids at most are broadcast to pick out the texts of candidates.
BROADCAST_IDS = 1_000_000

_LETTERS, _VALUES = letters_in(SPACE_BYTES), byte_values(LOWER)
_CHAIN = np.uint64(0x8CB92BA72F3D8DD7)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    starts, ends, rows = spans(data, offsets, _LETTERS)
    words = hash_spans(data, starts, ends, _VALUES)
    count = max(len(words) - WORDS + 1, 0)
    chain = np.zeros(count, np.uint64)
    for k in range(WORDS if count else 0):
        chain = chain * _CHAIN + words[k : k + count]
    chain = mix(chain + np.uint64(WORDS))
    out = []
    for a, b in zip(rows.tolist(), rows[1:].tolist()):
        if b - a >= WORDS:
            own = np.sort(chain[a : b - WORDS + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            one = np.zeros(1, np.uint64)
            for word in words[a:b]:
                one = one * _CHAIN + word
            out.append(mix(one + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def bin_values(sets: list[np.ndarray]) -> np.ndarray:
    """One row of densified bins per set; rows of empty sets are zero."""
    size = np.array([len(s) for s in sets])
    values, filled = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    if size.sum():
        hashes = np.concatenate(sets)
        place = np.repeat(np.arange(len(sets)), size) * BINS + (hashes >> _BIN_SHIFT).astype(np.int64)
        first = np.concatenate([[True], place[1:] != place[:-1]])  # sorted: the first is the least
        values.ravel()[place[first]] = hashes[first]
        filled.ravel()[place[first]] = True
    rows, bins = np.nonzero(~filled & (size > 0)[:, None])
    draw = 0
    while len(rows):
        source = (mix((bins + BINS * draw).astype(np.uint64)) % np.uint64(BINS)).astype(np.int64)
        found = filled[rows, source]
        values[rows[found], bins[found]] = values[rows[found], source[found]]
        rows, bins = rows[~found], bins[~found]
        draw += 1
    return values


def band_hashes(values: np.ndarray, band: int = BAND) -> np.ndarray:
    """A bucket number for each row and band of so many bins."""
    bands = values.reshape(len(values), BINS // band, band)
    out = np.broadcast_to(np.arange(1, BINS // band + 1, dtype=np.uint64), bands.shape[:2])
    for k in range(band):
        out = mix(out * _CHAIN + bands[:, :, k])
    return out.view(np.int64)


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by ``n_shingles``, ``set_id`` (a digest of the set) and ``buckets``."""

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            sets = shingle_sets(*utf8(piece.column(text)))
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            size = np.array([len(s) for s in sets], np.int64)
            buckets = band_hashes(bin_values(sets))[size > 0]
            ends = np.concatenate([[0], np.cumsum((size > 0) * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets.ravel()))
            return [pa.array(size), pa.array(digest, pa.binary()), lists]

        return work

    fields = [("n_shingles", "long"), ("set_id", "binary"), ("buckets", "array<long>")]
    return with_columns(docs, text, fields, make, without=(text,))


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough, in hundredths."""
    ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)  # texts that are no candidate's then stay where they are
    texts = docs.join(ids, "id", "left_semi").dropDuplicates(["id"])
    both = pairs.join(texts.select(F.col("id").alias("v"), F.col("text").alias("tv")), "v")
    both = both.join(texts.select(F.col("id").alias("u"), F.col("text").alias("tu")), "u")

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            ours, theirs = (shingle_sets(*utf8(piece.column(c))) for c in ("tu", "tv"))
            linked = []
            for a, b in zip(ours, theirs):
                both = np.sort(np.concatenate([a, b]))
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= threshold * (len(both) - shared))
            return [pa.array(linked, pa.bool_())]

        return work

    tested = with_columns(both, "tu", [("linked", "boolean")], make, without=("tu", "tv"))
    return tested.where("linked").select("u", "v")


def near_duplicates(
    docs: DataFrame, threshold: int = 75, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    ``threshold`` is the least similarity in hundredths.
    """
    return marked_texts(docs, threshold, doc_id, text).drop("text_hash")


def marked_texts(
    docs: DataFrame, threshold: int = 75, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``near_duplicates`` with ``text_hash``, which tells texts of one id apart."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    signed = cut_lineage(signatures(docs))
    texts = signed.where("id IS NOT NULL").groupBy("id").agg(F.min("hash").alias("a"), F.max("hash").alias("b"))
    several = not texts.where("a < b").isEmpty()
    if several:  # an id does not tell a text
        key = F.when(F.col("id").isNotNull(), F.struct("id", "hash"))
        docs, signed = docs.withColumn("id", key), signed.withColumn("id", key)
    classes = (
        signed.where("set_id IS NOT NULL AND id IS NOT NULL")
        .groupBy("set_id")
        .agg(
            F.min("id").alias("class_id"),
            F.min_by("buckets", "id").alias("buckets"),
            F.first("n_shingles").alias("n"),
        )
    )
    inside = classes.select(
        F.explode(F.array_distinct("buckets")).alias("bucket"), F.col("class_id").alias("v"), "n"
    )
    shared = inside.groupBy("bucket").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    shared = shared.where("least < most").select("bucket")
    # Of a band's bucket nothing is known about the members from there on.
    left = inside.join(shared, "bucket").select("bucket", "v", "n", F.col("n").alias("rest"), F.col("v").alias("label"))
    left = cut_lineage(left)
    roots = None
    number = 0
    while not left.isEmpty():
        centres = CENTRES[min(number, len(CENTRES) - 1)]
        hub = _centres(left, centres)
        pairs = cut_lineage(_candidates(left, hub, threshold))
        links = confirmed(pairs, docs, threshold)
        roots = stars(links if roots is None else roots.unionByName(links))
        left = _unsettled(left, roots, hub)
        if not number and not left.isEmpty():
            left = cut_lineage(_mixed(_rare_shingles(left, docs, threshold)))
        del hub, pairs, links
        release(docs.sparkSession)
        number += 1
    member = signed.select("id", "hash", "n_shingles", "set_id").join(classes.select("set_id", "class_id"), "set_id", "left")
    if roots is None:
        member = member.withColumn("root", F.lit(None).cast(signed.schema["id"].dataType))
    else:
        member = member.join(roots.select(F.col("u").alias("class_id"), F.col("v").alias("root")), "class_id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "class_id", "id"))
    return member.select(
        (F.col("id.id") if several else F.col("id")).alias(doc_id),
        F.col("hash").alias("text_hash"),
        "n_shingles",
        (component["id"] if several else component).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _centres(left: DataFrame, centres: int) -> DataFrame:
    """Some documents of each bucket: the least, later those outside its largest component first."""
    if centres == 1:
        return left.groupBy("bucket").agg(F.min(F.struct("v", "label", "n", "rest")).alias("c")).select("bucket", "c.*")
    sizes = left.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("size", "label")).alias("most"))
    known = left.join(largest.select("bucket", F.col("most.label").alias("main")), "bucket")
    order = Window.partitionBy("bucket").orderBy(F.col("label") == F.col("main"), "v")
    return known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= centres).drop("place", "main")


def _candidates(left: DataFrame, hub: DataFrame, threshold: int) -> DataFrame:
    """Each bucket's centres against its other documents of another component.

    No candidates are sets whose sizes alone rule out the similarity, or whose members from
    the bucket's shingle on (``rest``, in an order that is the same for all sets) are too few.
    """
    hub = hub.select(
        "bucket",
        F.col("v").alias("u"),
        F.col("label").alias("other"),
        F.col("n").alias("size"),
        F.col("rest").alias("remainder"),
    )
    near = F.least("n", "size") * 100 >= F.greatest("n", "size") * threshold
    enough = F.least("rest", "remainder") * (100 + threshold) >= (F.col("n") + F.col("size")) * threshold
    both = left.join(hub, "bucket").where("u <> v AND label <> other").where(near & enough)
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _unsettled(left: DataFrame, roots: DataFrame, hub: DataFrame) -> DataFrame:
    """The documents that are still to be compared: not centres yet, in buckets of several components."""
    labels = roots.select(F.col("u").alias("v"), F.col("v").alias("root"))
    fresh = left.select("bucket", "v", "n", "rest").join(labels, "v", "left")
    fresh = fresh.select("bucket", "v", "n", "rest", F.coalesce("root", "v").alias("label"))
    rest = fresh.join(hub.select("bucket", "v"), ["bucket", "v"], "left_anti")
    return cut_lineage(_mixed(rest))


def _mixed(left: DataFrame) -> DataFrame:
    """Only buckets that hold documents of several components."""
    labels = left.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    return left.join(labels.where("least < most").select("bucket"), "bucket")


def _rare_shingles(left: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Buckets anew for documents that bands have brought together, but stars have not linked.

    Such documents are often alike without being similar enough, as when many share a long
    passage; their bands would make them candidates again and again.  Of two sets that are
    similar enough, each has one of the other's rarest shingles among its own rarest ones, if
    it takes so many that the rest is too few.  So those shingles are the buckets, and what
    many documents share is none.
    """
    known = left.select("v", "n", "label").distinct()
    if known.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    texts = docs.join(known, F.col("id") == F.col("v")).dropDuplicates(["v"]).select("v", "n", "label", "text")

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            sets = shingle_sets(*utf8(piece.column("text")))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            hashes = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes))]

        return work

    rows = with_columns(texts, "text", [("all", "array<long>")], make, without=("text",))
    rows = rows.select("v", "n", "label", F.explode("all").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("v")
    ranked = rows.join(shared, "bucket").select(
        "*",
        F.row_number().over(own.orderBy("df", "bucket")).alias("place"),
        F.count(F.lit(1)).over(own).alias("in_others"),
    )
    # Shingles that no other document has come first, and need no bucket.
    enough = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    chosen = ranked.where(F.col("place") + F.col("n") - F.col("in_others") <= enough)
    rest = F.col("in_others") - F.col("place") + 1
    return chosen.select("bucket", "v", "n", rest.alias("rest"), "label")
