"""Language-model scores of texts from a weighted backoff automaton.

Documents are dealt into blocks.  A block lists its distinct words and word pairs with
their counts in training texts, as hashes in number order; ranges of hashes are buckets,
where the lists of all blocks meet and are summed, and each block gets back the corpus
counts for its own lists.  So nothing larger than a block or a bucket is ever in one task,
and a frequent word is one entry of each block.

From the counts a block builds the part of the automaton that its texts can reach: a root
with an arc per word (absolute discounting; what it takes off is the weight of an unknown
word), a state per training word with an arc per word seen after it, and a failure arc to
the root.  The end of a text is a word of its own, and the state that a text starts in.
A state depends on the last word alone, so that one pass from left to right is a lookup of
all places of a block at once.

NULL texts count as empty ones: they hold the end alone.  Without training texts every word
is unknown, with probability 1.  Documents without an id are training documents; equal rows
count and score each for itself.  Hashes have 64 bits: ten million distinct words share one
with odds of one in 300,000.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprep.llm.common import (
    LOWER,
    SPACE_BYTES,
    byte_values,
    count_and_bytes,
    hash_spans,
    letters_in,
    mix,
    parts_of,
    spans,
    utf8,
)

#: Bytes of text in a block, and about as many of hashes in a bucket.
BLOCK_BYTES = 8 << 20
#: Weight of what was seen after a word, for frequent words; the rest goes to the root.
SHARE = 0.1

_LETTERS, _VALUES = letters_in(SPACE_BYTES), byte_values(LOWER)
_END = np.uint64(0xA0761D6478BD642F)
_PAIR = np.uint64(0xE7037ED1A0B428DB)


class Block:
    """Tokens of a block's texts: distinct words and pairs, and where they stand."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        data, offsets = utf8(texts)
        starts, ends, rows = spans(data, offsets, _LETTERS)
        words = hash_spans(data, starts, ends, _VALUES)
        self.size = np.diff(rows) + 1
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        tokens = np.insert(words, rows[1:], _END)
        before = np.concatenate([[_END], tokens[:-1]]).astype(np.uint64)
        self.word, self.words = _distinct(tokens)
        self.pair, self.pairs = _distinct(mix(before * _PAIR + tokens))
        # The word before a text's first one is the end.
        end = self.word[self.first[0] + self.size[0] - 1] if len(self.size) else 0
        self.before = np.concatenate([[end], self.word[:-1]])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its number, and the distinct keys in order."""
    number, found = pd.factorize(keys)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return place[number], found[order]


def _bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys, and where the last one ends."""
    number = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(number.astype(np.int64), np.arange(buckets + 1))


_LISTS = "block int, bucket int, words binary, word_counts binary, pairs binary, pair_counts binary"
_ANSWERS = "block int, bucket int, word_counts binary, pair_counts binary, n long, v long, once long, twice long"
_SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _lists(buckets: int):
    """A block's lists for each bucket; a bucket without entries gets a row too."""

    def make(key: tuple, docs: pa.Table) -> pa.Table:
        block = Block(docs.column("text"))
        train = np.repeat(~docs.column("held_out").to_numpy(), block.size)
        out: dict[str, list] = {"block": [key[0].as_py()] * buckets, "bucket": list(range(buckets))}
        for name, keys, place in (("word", block.words, block.word), ("pair", block.pairs, block.pair)):
            counts = np.bincount(place[train], minlength=len(keys)).astype("<u4")
            edges = _bucket_edges(keys, buckets).tolist()
            cut = list(zip(edges, edges[1:]))
            out[f"{name}s"] = [keys[a:b].astype("<u8").tobytes() for a, b in cut]
            out[f"{name}_counts"] = [counts[a:b].tobytes() for a, b in cut]
        return pa.table(
            [out["block"], out["bucket"], out["words"], out["word_counts"], out["pairs"], out["pair_counts"]],
            pa.schema(
                [("block", pa.int32()), ("bucket", pa.int32())]
                + [(n, pa.binary()) for n in ("words", "word_counts", "pairs", "pair_counts")]
            ),
        )

    return make


def _summed(lists: pa.Table, name: str) -> tuple[list[np.ndarray], np.ndarray]:
    """For each block's list the corpus counts of its keys; and the corpus counts of all keys."""
    keys = [np.frombuffer(x, "<u8") for x in lists.column(f"{name}s").to_pylist()]
    counts = [np.frombuffer(x, "<u4") for x in lists.column(f"{name}_counts").to_pylist()]
    number, found = pd.factorize(np.concatenate(keys))
    total = np.bincount(number, np.concatenate(counts), len(found)).astype("<u8")
    edges = np.cumsum([0] + [len(k) for k in keys])
    return [total[number[a:b]] for a, b in zip(edges, edges[1:])], total


def _sum(key: tuple, lists: pa.Table) -> pa.Table:
    """A bucket's answers to all blocks, each with the bucket's share of the corpus totals."""
    words, total = _summed(lists, "word")
    pairs, _ = _summed(lists, "pair")
    rows = lists.num_rows
    totals = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
    return pa.table(
        [
            lists.column("block"),
            lists.column("bucket"),
            pa.array([w.tobytes() for w in words], pa.binary()),
            pa.array([p.tobytes() for p in pairs], pa.binary()),
            *[pa.array([t] * rows, pa.int64()) for t in totals],
        ],
        ["block", "bucket", "word_counts", "pair_counts", "n", "v", "once", "twice"],
    )


class Automaton:
    """Log10 weights: of the root's arcs, of the arcs of word states, and of failure arcs."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, n: int, v: int, once: int, twice: int, share: float) -> None:
        discount = once / (once + 2 * twice) if once and twice else 0.5
        root = np.where(words > 0, words - discount, discount * v) / n if n else np.ones(len(words))
        take = share * words / (words + 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.root, self.failure = np.log10(root), np.log10(1 - take)
            # An arc is known by its first place in the block.
            at = np.empty(len(pairs), np.int64)
            at[block.pair[::-1]] = np.arange(len(block.pair))[::-1]
            state, word = block.before[at], block.word[at]
            self.arc = np.log10(take[state] * pairs / np.maximum(words[state], 1) + (1 - take[state]) * root[word])
        self.seen = pairs > 0

    def walk(self, block: Block) -> np.ndarray:
        """The log-probability of each token, given the state its text is in before it."""
        back = self.failure[block.before] + self.root[block.word]
        return np.where(self.seen[block.pair], self.arc[block.pair], back)


def _score(names: list[str], share: float):
    def make(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(docs.column("text"))
        answers = answers.sort_by("bucket")
        words = np.frombuffer(b"".join(answers.column("word_counts").to_pylist()), "<u8").astype(float)
        pairs = np.frombuffer(b"".join(answers.column("pair_counts").to_pylist()), "<u8").astype(float)
        n, v, once, twice = (sum(answers.column(c).to_pylist()) for c in ("n", "v", "once", "twice"))
        score = Automaton(block, words, pairs, n, v, once, twice, share).walk(block)
        base = np.log10((words + 0.1) / (n + 0.1 * (v + 1)))
        known = (words > 0).astype(np.int64)
        columns = [
            pa.array(block.size),
            pa.array(np.add.reduceat(known[block.word], block.first)),
            pa.array(np.full(len(block.size), n, np.int64)),
            pa.array(np.add.reduceat(base[block.word], block.first)),
            pa.array(np.add.reduceat(score, block.first)),
        ]
        kept = docs.select(names)
        titles = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table([*kept.columns, *columns], [*names, *titles])

    return make


def score_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    folds: int = 10,
    share: float = SHARE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document its token counts, a smoothed word score and the automaton's score.

    Documents whose crc32(id as text) is divisible by ``folds`` are scored but not learnt from.
    """
    number = parts_of(docs.sparkSession, count_and_bytes(docs, text)[1], block_bytes)
    own = F.col(f"`{doc_id}`")
    blocks = docs.select(
        own.alias("doc_id"),
        F.coalesce(F.crc32(own.cast("string")) % folds == 0, F.lit(False)).alias("held_out"),
        F.col(f"`{text}`").alias("text"),
        F.pmod(F.xxhash64(own, F.col(f"`{text}`")), F.lit(number)).cast("int").alias("block"),
    )
    lists = blocks.groupBy("block").applyInArrow(_lists(number), _LISTS)
    answers = lists.groupBy("bucket").applyInArrow(_sum, _ANSWERS)
    kind = dict(blocks.dtypes)["doc_id"]
    scored = (
        blocks.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_score(["doc_id", "held_out"], share), f"doc_id {kind}, held_out boolean, {_SCORES}")
    )
    return scored if doc_id == "doc_id" else scored.withColumnRenamed("doc_id", doc_id)
