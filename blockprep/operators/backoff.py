"""Scores from the tokens that a slot sees on both sides, by backoff from longer contexts.

A path lists neighbours of a slot in the order of their weight, as distances: -1 is the token in
front, 1 the one behind.  A context of depth d holds the tokens at the first d distances.  The
contexts of all depths make an automaton: a state is a known context, its arcs add the token at
the next distance, and where no arc fits, or the neighbour is not visible, the walk fails to the
state it is in, the longest known context.  Depth 0 is the state of slots that know nothing.

Neighbours count as seen if the query of the slot, the position in front of it, sees them: all
that is in front, and behind it what stands in the query's own block (of training blocks when
fitted, of the current block when filled).  Masked neighbours are tokens like others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockprep.config import IGNORE_LABEL, PrepConfig
from blockprep.functions.arrays import visible_upto
from blockprep.operators.alias import alias_tables
from blockprep.operators.scores import ANY_CONTEXT, SHARE_DIGITS, argmax, nucleus, scale, softmax, suppress

#: The token in front alone.
FRONT = (-1,)
KEYS = ["depth", "ctx"]


def _neighbour(distance: int) -> Column:
    """For every position the token at a distance, NULL outside."""
    ids, size, many = F.col("input_ids"), F.size("input_ids"), abs(distance)
    gap = F.array_repeat(F.lit(None).cast("int"), F.least(F.lit(many), size))
    kept = F.greatest(size - many, F.lit(0))
    if distance < 0:
        return F.concat(gap, F.slice(ids, F.lit(1), kept))
    return F.concat(F.slice(ids, F.lit(many + 1), kept), gap)


def context_rows(views: DataFrame, cfg: PrepConfig, path: Sequence[int] = FRONT) -> DataFrame:
    """(batch_id, view, pos, label, depth, ctx) for labelled positions that see their first neighbour."""
    names = [f"n{i}" for i in range(len(path))]
    lined = views.select(
        "batch_id",
        "view",
        F.size("input_ids").alias("length"),
        F.arrays_zip(F.col("labels").alias("label"), *[_neighbour(d).alias(n) for d, n in zip(path, names)]).alias("row"),
    )
    rows = lined.select("batch_id", "view", "length", F.posexplode("row").alias("pos", "row")).where(
        F.col("row.label") != IGNORE_LABEL
    )
    sees = visible_upto(F.col("pos") - 1, F.col("length"), cfg.block_size)
    depths = [F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("ctx"))]
    known = F.lit(True)
    for i, distance in enumerate(path):
        known = known & F.col(f"row.n{i}").isNotNull()
        if distance > 0:
            known = known & (F.col("pos") + distance < sees)
        ctx = F.array(*[F.col(f"row.n{k}") for k in range(i + 1)])
        depths.append(F.when(known, F.struct(F.lit(i + 1).alias("depth"), ctx.alias("ctx"))))
    first = F.col("row.n0").isNotNull() if path else F.lit(True)
    return (
        rows.where(first)
        .select("batch_id", "view", "pos", F.col("row.label").alias("label"), F.explode(F.array_compact(F.array(*depths))).alias("c"))
        .select("batch_id", "view", "pos", "label", "c.depth", "c.ctx")
    )


def count_contexts(views: DataFrame, cfg: PrepConfig, path: Sequence[int] = FRONT) -> DataFrame:
    """(depth, ctx, label, n): how often a label has a context; summed map-side first."""
    return context_rows(views, cfg, path).groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Backoff:
    """A path and the scores (depth, ctx, token_id, logit) of the contexts along it."""

    table: DataFrame
    path: tuple[int, ...] = FRONT

    @staticmethod
    def fit(views: DataFrame, cfg: PrepConfig, path: Sequence[int] = FRONT) -> Backoff:
        counts = count_contexts(views, cfg, path)
        table = counts.select(*KEYS, F.col("label").alias("token_id"), F.log(F.col("n").cast("double")).alias("logit"))
        return Backoff(table, tuple(path))

    @staticmethod
    def of_scores(scores: DataFrame) -> Backoff:
        """From a table (ctx, token_id, logit) by the token in front, ``ANY_CONTEXT`` being depth 0."""
        any_ = F.col("ctx") == ANY_CONTEXT
        ctx = F.when(any_, F.array().cast("array<int>")).otherwise(F.array(F.col("ctx").cast("int")))
        return Backoff(scores.select((~any_).cast("int").alias("depth"), ctx.alias("ctx"), "token_id", "logit"))

    @property
    def reach(self) -> int:
        """How many tokens in front a slot may look at."""
        return max([-d for d in self.path if d < 0], default=0)

    def prepared(self, suppressed: DataFrame, cfg: PrepConfig) -> DataFrame:
        """One row per context (greedy) or candidate: what a draw needs, shares rounded.

        (depth, ctx, size, cell, token_id, prob, accept, alias_id, alias_prob); greedy contexts
        have one cell that is theirs alone.
        """
        allowed = suppress(self.table, suppressed)
        if cfg.temperature <= 0:
            best = argmax(softmax(allowed, KEYS), KEYS, by="logit", keep=["prob"])
            drawn = best.select(
                *KEYS,
                F.lit(1).cast("long").alias("size"),
                F.lit(0).alias("cell"),
                "token_id",
                "prob",
                F.lit(1.0).alias("accept"),
                F.col("token_id").alias("alias_id"),
                F.col("prob").alias("alias_prob"),
            )
        else:
            probs = softmax(scale(allowed, cfg.temperature), KEYS)
            drawn = alias_tables(nucleus(probs, KEYS, cfg.top_p), KEYS)
        return drawn.withColumns({c: F.round(c, SHARE_DIGITS) for c in ("prob", "alias_prob")})


class Automaton:
    """The contexts of a prepared table as sorted arcs, for whole arrays of slots at once.

    The table is sorted by depth, context and cell.
    """

    def __init__(self, table: pa.Table, path: Sequence[int]) -> None:
        self.path = tuple(path)
        table = table.combine_chunks()
        depth = table.column("depth").to_numpy()
        cell = table.column("cell").to_numpy().astype(np.int64)
        self.token, self.alias = (table.column(c).to_numpy().astype(np.int64) for c in ("token_id", "alias_id"))
        self.prob, self.accept, self.alias_prob = (table.column(c).to_numpy() for c in ("prob", "accept", "alias_prob"))
        contexts = table.column("ctx").combine_chunks()
        values, places = contexts.flatten().to_numpy().astype(np.int64), contexts.offsets.to_numpy()
        places = places - places[0]
        starts = np.flatnonzero(cell == 0)
        # By depth: arcs (node in front, token), sorted, and the nodes they lead to.
        self.arcs: list[np.ndarray] = []
        self.nodes: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        total = 0
        for d in range(len(self.path) + 1):
            own = starts[depth[starts] == d]
            if d:
                tokens = values[places[own][:, None] + np.arange(d)]
                key = (self._reached(tokens[:, :-1]) << np.int64(32)) + tokens[:, -1]
                order = np.argsort(key)
                own = own[order]
                self.arcs.append(key[order])
                self.nodes.append(np.arange(total, total + len(own)))
            rows.append(own)
            total += len(own)
        #: The first row of each node's candidates, and their number.
        self.row = np.concatenate(rows)
        self.size = table.column("size").to_numpy().astype(np.int64)[self.row]

    def _reached(self, tokens: np.ndarray) -> np.ndarray:
        node = np.zeros(len(tokens), np.int64)
        for d in range(tokens.shape[1]):
            node, _ = self._step(d, node, tokens[:, d])
        return node

    def _step(self, d: int, node: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Along the arcs of depth d to d + 1: the next node, and whether there is one."""
        arcs = self.arcs[d]
        if not len(arcs):
            return node, np.zeros(len(node), bool)
        key = (node << np.int64(32)) + token
        at = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
        found = arcs[at] == key
        return np.where(found, self.nodes[d][at], node), found

    def states(self, neighbours: np.ndarray, visible: np.ndarray) -> np.ndarray:
        """The longest known context of each slot (slots x path), over visible neighbours only."""
        node, open_ = np.zeros(len(neighbours), np.int64), np.ones(len(neighbours), bool)
        for d in range(len(self.path)):
            further, found = self._step(d, node, neighbours[:, d])
            open_ = open_ & visible[:, d] & found
            node = np.where(open_, further, node)
        return node

    def draw(self, node: np.ndarray, u: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Token and share for each state; ``u`` in [0, 1) picks cell and side, greedy needs none."""
        row = self.row[node]
        if u is None:
            return self.token[row], self.prob[row]
        scaled = u * self.size[node]
        cell = np.floor(scaled)
        row = row + cell.astype(np.int64)
        own = scaled - cell < self.accept[row]
        return np.where(own, self.token[row], self.alias[row]), np.where(own, self.prob[row], self.alias_prob[row])
