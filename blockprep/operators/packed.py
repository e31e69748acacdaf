"""Filling on packed rows: one row per sequence, its current block as one array.

A block's passes need nothing but the row itself and the candidate table, so that they are a
projection: no slot is a row of its own, and nothing moves between tasks.  Inside, a batch of
sequences is a matrix; sequences that are finished and slots that are filled are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockprep.config import PrepConfig
from blockprep.operators.backoff import Automaton
from blockprep.operators.scores import SHARE_DIGITS

#: Sequences worked on at once.
BATCH = 4096


class Proposer(Protocol):
    """Candidates for open slots: token and share of each, from what the slot sees."""

    def propose(self, seen: list[np.ndarray], blocks: np.ndarray, rows: np.ndarray, slots: np.ndarray, u: Callable) -> tuple[np.ndarray, np.ndarray]:
        """``seen`` and ``blocks`` hold the tokens in front of and in the block of each sequence.

        ``u()`` gives a number in [0, 1) for each slot, fixed by seed, step and place.
        """


class FromTable:
    """Candidates of an automaton's states."""

    def __init__(self, automaton: Automaton, cfg: PrepConfig) -> None:
        self.automaton, self.greedy, self.mask = automaton, cfg.temperature <= 0, cfg.mask_id

    def propose(self, seen, blocks, rows, slots, u):
        length, path = blocks.shape[1], self.automaton.path
        neighbours = np.full((len(rows), len(path)), self.mask, np.int64)
        visible = np.ones(neighbours.shape, bool)
        for i, distance in enumerate(path):
            at = slots + distance
            if distance > 0:  # the query in front of a block does not see into it
                visible[:, i] = (slots > 0) & (at < length)
            inside = (at >= 0) & (at < length)
            neighbours[inside, i] = blocks[rows[inside], at[inside]]
            before = at < 0
            if before.any():
                back = np.array([len(s) for s in seen])[rows[before]] + at[before]
                neighbours[before, i] = [seen[r][b] if b >= 0 else self.mask for r, b in zip(rows[before].tolist(), back.tolist())]
        return self.automaton.draw(self.automaton.states(neighbours, visible), None if self.greedy else u())


class FromModel:
    """Candidates of a caller's model, as ``model(tokens, query, upto)`` to (token ids, logits).

    ``tokens`` are all tokens of a sequence up to the end of its block, ``query`` is the position
    that a slot is scored at, the one in front of it, and ``upto`` the first position that the
    query does not see.  Suppression, temperature and nucleus are applied here.
    """

    def __init__(self, model: Callable, suppressed: Sequence[int], cfg: PrepConfig) -> None:
        self.model, self.suppressed, self.cfg = model, np.array(sorted(suppressed)), cfg

    def propose(self, seen, blocks, rows, slots, u):
        draws = None if self.cfg.temperature <= 0 else u()
        out_id, out_share = np.empty(len(rows), np.int64), np.empty(len(rows))
        for i, (row, slot) in enumerate(zip(rows.tolist(), slots.tolist())):
            tokens = np.concatenate([seen[row], blocks[row]])
            upto = len(tokens) if slot else len(seen[row])
            ids, logits = self.model(tokens, max(len(seen[row]) + slot - 1, 0), upto)
            out_id[i], out_share[i] = self._pick(np.asarray(ids), np.asarray(logits, float), None if draws is None else draws[i])
        return out_id, out_share

    def _pick(self, ids: np.ndarray, logits: np.ndarray, u: float | None) -> tuple[int, float]:
        allowed = ~np.isin(ids, self.suppressed)
        if not allowed.any():
            raise ValueError("the model leaves no candidate for a slot")
        ids, logits = ids[allowed], logits[allowed] / (1 if u is None else self.cfg.temperature)
        order = np.lexsort((ids, -logits))
        shares = np.exp(logits[order] - logits[order[0]])
        shares /= shares.sum()
        if u is None:
            return int(ids[order[0]]), round(float(shares[0]), SHARE_DIGITS)
        before = np.round(np.cumsum(shares) - shares, SHARE_DIGITS)
        kept = shares[(before <= self.cfg.top_p) | (np.arange(len(shares)) == 0)]
        kept = kept / kept.sum()
        at = min(int(np.searchsorted(np.round(np.cumsum(kept), SHARE_DIGITS), u, "right")), len(kept) - 1)
        return int(ids[order[at]]), round(float(kept[at]), SHARE_DIGITS)


def _uniform(seed: int, step: int, names: list, rows: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The numbers of ``functions.hashing.uniform`` for slots of these sequences."""
    keys = (f"{seed}:{step}:{names[r]}:{p}" for r, p in zip(rows.tolist(), positions.tolist()))
    return np.array([int(hashlib.md5(k.encode()).hexdigest()[:8], 16) for k in keys], float) / 2**32


def complete_at(ids: np.ndarray, cfg: PrepConfig) -> np.ndarray:
    """For each row the place of its first EOS if nothing masked stands in front of it, else -1."""
    if cfg.eos_id is None:
        return np.full(len(ids), -1)
    length = ids.shape[1]
    place = lambda hit: np.where(hit.any(axis=1), hit.argmax(axis=1), length)
    eos, mask = place(ids == cfg.eos_id), place(ids == cfg.mask_id)
    return np.where(eos < mask, eos, -1)


def fill_matrix(
    seen: list[np.ndarray], names: list, length: int, start: int, step: int, cfg: PrepConfig, proposer: Proposer
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fill one block of each sequence: (ids, steps or -1, place of a complete EOS or -1, passes)."""
    ids = np.full((len(seen), length), cfg.mask_id, np.int64)
    steps = np.full(ids.shape, -1, np.int64)
    ends, passes = np.full(len(seen), -1), np.zeros(len(seen), np.int64)
    size = cfg.sub_block_size
    sub_blocks = -(-length // size)
    for number in range(4 * length):
        open_ = (ends < 0) & (ids == cfg.mask_id).any(axis=1)
        if not open_.any():
            break
        passes[open_] = number + 1
        for k in range(sub_blocks):
            now = step + number * sub_blocks + k
            part = (ids[:, k * size : (k + 1) * size] == cfg.mask_id) & open_[:, None]
            rows, slots = np.nonzero(part)
            if not len(rows):
                continue
            slots = slots + k * size
            tokens, shares = proposer.propose(seen, ids, rows, slots, lambda: _uniform(cfg.seed, now, names, rows, slots + start))
            order = np.lexsort((slots, -shares, rows))
            best = np.zeros(len(rows), bool)
            best[order[np.concatenate([[True], rows[order][1:] != rows[order][:-1]])]] = True
            chosen = best | (shares > cfg.threshold)
            ids[rows[chosen], slots[chosen]] = tokens[chosen]
            steps[rows[chosen], slots[chosen]] = now
        ends = np.where(open_, complete_at(ids, cfg), ends)
    left = (ids == cfg.mask_id) & (ends < 0)[:, None]
    ids[left] = cfg.eos_id if cfg.eos_id is not None else (cfg.padding_id if cfg.padding_id is not None else cfg.mask_id)
    return ids, steps, np.where(ends < 0, complete_at(ids, cfg), ends), passes


def fill_block(
    state: DataFrame, length: int, start: int, step: int, cfg: PrepConfig, proposer: Callable[[], Proposer], keep: int | None
) -> DataFrame:
    """From (seq_id, seen) to (seq_id, seen, block, steps, eos, passes), one row per sequence.

    ``proposer`` is called in each task; ``keep`` says how many tokens the next block needs
    in front of it (None: all).  ``eos`` is the place of a complete EOS in the block, or NULL.
    """
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([state.schema["seq_id"], T.StructField("seen", ints), T.StructField("block", ints)])
    schema = schema.add("steps", ints).add("eos", "integer").add("passes", "integer")

    def lists(rows: list) -> pa.Array:
        sizes = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = proposer()
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH):
                batch = whole.slice(first, BATCH)
                seen = [np.asarray(s if s is not None else [], np.int64) for s in batch.column("seen").to_pylist()]
                ids, steps, ends, passes = fill_matrix(
                    seen, batch.column("seq_id").to_pylist(), length, start, step, cfg, asked
                )
                after = [np.concatenate([s, i]) for s, i in zip(seen, ids)]
                after = after if keep is None else [a[max(len(a) - keep, 0) :] for a in after]
                known = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(ids) + 1, dtype=np.int32) * length),
                    pa.array(steps.ravel().astype(np.int32), mask=(steps < 0).ravel()),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("seq_id"),
                        lists(after),
                        lists(list(ids)),
                        known,
                        pa.array(ends.astype(np.int32), mask=ends < 0),
                        pa.array(passes.astype(np.int32)),
                    ],
                    [field.name for field in schema.fields],
                )

    return state.select("seq_id", "seen").mapInArrow(run, schema)


def block_slots(filled: DataFrame, start: int) -> DataFrame:
    """The slots (seq_id, pos, token_id, step) of a filled block, up to its complete EOS."""
    upto = F.coalesce(F.col("eos") + 1, F.size("block"))
    both = F.arrays_zip(F.slice("block", F.lit(1), upto).alias("token_id"), F.slice("steps", F.lit(1), upto).alias("step"))
    return filled.select("seq_id", F.posexplode(both).alias("pos", "s")).select(
        "seq_id", (F.col("pos") + start).alias("pos"), "s.token_id", "s.step"
    )
