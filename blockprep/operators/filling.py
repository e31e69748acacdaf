"""Round-by-round filling of masked slots, for all sequences at once.

Slots are rows (seq_id, pos, token_id); ``pos`` counts from the first new
token.  A slot is scored at the position in front of it (the one-step shift),
from the tokens visible there, so candidates are a table keyed by context,
prepared once before the loop.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockprep.config import PrepConfig
from blockprep.functions.arrays import prefix_visible_upto
from blockprep.functions.hashing import uniform
from blockprep.operators.backoff import Automaton, Backoff
from blockprep.operators.packed import FromModel, FromTable, Proposer, block_slots, fill_block
from blockprep.operators.scores import argmax, select_confident, softmax, suppress
from blockprep.operators.tokens import named_join
from blockprep.sources.storage import cut_lineage

# A candidate table is broadcast up to this many rows (some 60 bytes each) and
# joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Candidates:
    """What may follow each context, prepared once: see ``Backoff.prepared``.

    ``spare`` is the row of depth 0, for slots of which no context is known.
    """

    table: DataFrame
    path: tuple[int, ...]
    small: bool
    spare: dict


def greedy_picks(scores: DataFrame, suppressed: DataFrame) -> DataFrame:
    """(ctx, token_id, prob): the best candidate of each context and its share."""
    probs = softmax(suppress(scores, suppressed), ["ctx"])
    return argmax(probs, ["ctx"], by="logit", keep=["prob"]).select("ctx", "token_id", "prob")


def prepare_candidates(
    scorer: Backoff, suppressed: DataFrame, cfg: PrepConfig, spare: tuple[int, float] | None = None
) -> Candidates:
    """Normalise the scores once; the loop only looks candidates up.

    ``spare`` is the token and share for slots of no known context; by default that is the
    distribution of depth 0, which must then be there.
    """
    table = cut_lineage(scorer.prepared(suppressed, cfg))
    if spare is None:
        first = table.where("depth = 0").orderBy("cell").select("size", "token_id", "prob").first()
        if first is None:
            raise ValueError("no candidate is left for contexts without scores")
        found = first.asDict()
    else:
        found = {"size": 1, "token_id": spare[0], "prob": spare[1]}
    return Candidates(table, scorer.path, table.count() <= BROADCAST_ROWS, found)


def _sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _neighbours(slots: DataFrame, path: tuple[int, ...], cfg: PrepConfig, block_start: int) -> DataFrame:
    """Add ``c1`` .. : the context of each depth that a slot knows, else NULL."""
    along = W.partitionBy("seq_id").orderBy("pos")
    place, length = F.col("pos") - block_start, F.max("pos").over(W.partitionBy("seq_id")) + 1
    sees = prefix_visible_upto(F.col("pos") - 1, length, length - block_start)
    tokens, known, made = [], F.lit(True), {}
    for i, distance in enumerate(path):
        if distance < 0:
            before = F.try_element_at("seen", (place + distance).cast("int"))
            token = F.when(place + distance >= 0, F.lag("token_id", -distance).over(along)).otherwise(before)
            token = F.coalesce(token, F.lit(cfg.mask_id))
        else:
            token = F.lead("token_id", distance).over(along)
            known = known & (F.col("pos") + distance < sees)
        tokens.append(token)
        made[f"c{i + 1}"] = F.when(known, F.array(*tokens))
    return slots.withColumns(made) if made else slots


def add_candidates(
    slots: DataFrame, candidates: Candidates, cfg: PrepConfig, step: int, block_start: int = 0
) -> DataFrame:
    """Add ``candidate`` and ``prob`` from the longest known context of each slot.

    Needs (seq_id, pos, token_id, seen), ``seen`` being the tokens in front of the block.
    """
    own, depths = slots.columns, range(1, len(candidates.path) + 1)
    asked = _neighbours(slots, candidates.path, cfg, block_start)
    heads = candidates.table.where("cell = 0")
    for d in depths:
        there = heads.where(F.col("depth") == d).select(
            F.col("ctx").alias(f"c{d}"), F.struct("size", "token_id", "prob").alias(f"h{d}")
        )
        asked = asked.join(_sized(there, candidates.small), f"c{d}", "left")
    spare = F.struct(*[F.lit(candidates.spare[c]).alias(c) for c in ("size", "token_id", "prob")])
    head = F.coalesce(*[F.col(f"h{d}") for d in reversed(depths)], spare)
    if cfg.temperature <= 0:
        return asked.select(*own, head["token_id"].alias("candidate"), head["prob"].alias("prob"))
    none = F.array().cast("array<int>")
    state = F.coalesce(*[F.when(F.col(f"h{d}").isNotNull(), F.struct(F.lit(d).alias("depth"), F.col(f"c{d}").alias("ctx"))) for d in reversed(depths)], F.struct(F.lit(0).alias("depth"), none.alias("ctx")))
    scaled = uniform(cfg.seed, step, F.col("seq_id"), F.col("pos")) * F.col("size")
    drawn = (
        asked.withColumns({"state": state, "size": head["size"]})
        .select(*own, "state.depth", "state.ctx", F.floor(scaled).alias("cell"), (scaled - F.floor(scaled)).alias("side"))
    )
    cells = candidates.table.select("depth", "ctx", F.col("cell").cast("long").alias("cell"), F.struct("token_id", "prob", "accept", "alias_id", "alias_prob").alias("a"))
    own_side = F.col("side") < F.col("a.accept")
    return drawn.join(_sized(cells, candidates.small), ["depth", "ctx", "cell"]).select(
        *own,
        F.when(own_side, F.col("a.token_id")).otherwise(F.col("a.alias_id")).alias("candidate"),
        F.when(own_side, F.col("a.prob")).otherwise(F.col("a.alias_prob")).alias("prob"),
    )


def apply_fills(slots: DataFrame, fills: DataFrame) -> DataFrame:
    """Write chosen tokens (seq_id, pos, token_id) into the slots."""
    new = fills.select("seq_id", "pos", F.col("token_id").alias("_fill"))
    return (
        slots.join(new, ["seq_id", "pos"], "left")
        .withColumn("token_id", F.coalesce("_fill", "token_id"))
        .drop("_fill")
    )


def fill_step(
    slots: DataFrame,
    candidates: Candidates,
    cfg: PrepConfig,
    step: int,
    block_start: int,
    sub_block: int | None = None,
) -> DataFrame:
    """One step: shift, score, select, write back; all sequences, one sub-block (or all).

    Needs (seq_id, pos, token_id, step, seen, finished).
    """
    own = slots.columns
    scored = add_candidates(slots, candidates, cfg, step, block_start).withColumn(
        "sub_block", F.floor((F.col("pos") - block_start) / cfg.sub_block_size)
    )
    open_slot = (F.col("token_id") == cfg.mask_id) & ~F.col("finished")
    if sub_block is not None:
        open_slot = open_slot & (F.col("sub_block") == sub_block)
    picked = select_confident(scored.withColumn("masked", open_slot), cfg.threshold)
    return picked.withColumns(
        {
            "token_id": F.when(F.col("chosen"), F.col("candidate")).otherwise(F.col("token_id")),
            "step": F.when(F.col("chosen"), F.lit(step)).otherwise(F.col("step")),
        }
    ).select(*own)


def has_mask(slots: DataFrame, cfg: PrepConfig, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """Per group: is any slot still masked?"""
    return slots.groupBy(*keys).agg(F.bool_or(F.col("token_id") == cfg.mask_id).alias("has_mask"))


def _first_where(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("pos")))


def complete_eos(slots: DataFrame, cfg: PrepConfig) -> DataFrame:
    """(seq_id, eos_pos): the first EOS, for sequences with nothing masked in front of it."""
    firsts = slots.groupBy("seq_id").agg(
        _first_where(F.col("token_id") == cfg.eos_id).alias("eos_pos"),
        _first_where(F.col("token_id") == cfg.mask_id).alias("_mask_pos"),
    )
    return firsts.where(
        F.col("eos_pos").isNotNull()
        & (F.col("_mask_pos").isNull() | (F.col("eos_pos") < F.col("_mask_pos")))
    ).drop("_mask_pos")


def _mark_finished(slots: DataFrame, cfg: PrepConfig) -> DataFrame:
    """The rule of ``complete_eos`` as a column on the slots of one block."""
    if cfg.eos_id is None:
        return slots
    sequence = W.partitionBy("seq_id")
    eos = _first_where(F.col("token_id") == cfg.eos_id).over(sequence)
    mask = _first_where(F.col("token_id") == cfg.mask_id).over(sequence)
    return slots.withColumn("finished", eos.isNotNull() & (mask.isNull() | (eos < mask)))


def fill_leftovers(slots: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Round guard: give every slot still masked the EOS id, or the pad id without one."""
    spare = cfg.eos_id if cfg.eos_id is not None else cfg.padding_id
    masked = (F.col("token_id") == cfg.mask_id) & ~F.col("finished")
    return slots.withColumn(
        "token_id", F.when(masked, F.lit(spare)).otherwise(F.col("token_id"))
    )


def append_block(heads: DataFrame, start: int, length: int, cfg: PrepConfig) -> DataFrame:
    """A block of masked slots for every sequence of (seq_id, seen)."""
    return heads.select(
        "seq_id",
        "seen",
        F.explode(F.sequence(F.lit(start), F.lit(start + length - 1))).alias("pos"),
    ).select(
        "seq_id",
        "pos",
        F.lit(cfg.mask_id).cast("int").alias("token_id"),
        F.lit(None).cast("int").alias("step"),
        "seen",
        F.lit(False).alias("finished"),
    )


def _logged(slots: DataFrame, log: str | None, first_step: int, sub_blocks: int) -> None:
    """Write the slots that each pass of a block filled to the pass's folder."""
    if log is None:
        return
    passed = F.floor((F.col("step") - first_step) / sub_blocks) * sub_blocks + first_step
    known = slots.where("step IS NOT NULL").select("seq_id", "step", "pos", "token_id", passed.alias("from_step"))
    known.write.mode("append").partitionBy("from_step").parquet(log)


def _fill_block(
    slots: DataFrame, candidates: Candidates, cfg: PrepConfig, start: int, length: int, step: int
) -> tuple[DataFrame, int]:
    """Passes over the sub-blocks until no open slot is left, with slots as rows."""
    sub_blocks = -(-length // cfg.sub_block_size)
    still_open = (F.col("token_id") == cfg.mask_id) & ~F.col("finished")
    for _ in range(4 * length):
        for sub_block in range(sub_blocks):
            slots = fill_step(slots, candidates, cfg, step, start, sub_block)
            step += 1
        slots = cut_lineage(_mark_finished(slots, cfg))
        if slots.where(still_open).isEmpty():
            return slots, step
    return _mark_finished(fill_leftovers(slots, cfg), cfg), step


def _fill_rows(heads: DataFrame, candidates: Candidates, cfg: PrepConfig, log: str | None) -> list[DataFrame]:
    """All blocks with slots as rows: for candidate tables that no task can hold."""
    blocks: list[DataFrame] = []
    done, step, heads = 0, 0, heads.repartition("seq_id")
    while done < cfg.max_new_tokens:
        length = min(cfg.block_size, cfg.max_new_tokens - done)
        first_step = step
        slots, step = _fill_block(append_block(heads, done, length, cfg), candidates, cfg, done, length, step)
        _logged(slots, log, first_step, -(-length // cfg.sub_block_size))
        blocks.append(slots.select("seq_id", "pos", "token_id", "step"))
        done += length
        heads = (
            slots.where(~F.col("finished"))
            .groupBy("seq_id")
            .agg(F.first("seen").alias("seen"), F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("new"))
            .select("seq_id", F.concat("seen", F.transform("new", lambda s: s["token_id"])).alias("seen"))
        )
        if done < cfg.max_new_tokens and heads.isEmpty():
            break
    return blocks


def _fill_packed(heads: DataFrame, proposer: Callable[[], Proposer], cfg: PrepConfig, log: str | None, keep: int | None) -> list[DataFrame]:
    """All blocks with a sequence as one row: a block is a projection, written once."""
    blocks: list[DataFrame] = []
    done, step, state = 0, 0, heads
    while done < cfg.max_new_tokens:
        length = min(cfg.block_size, cfg.max_new_tokens - done)
        sub_blocks = -(-length // cfg.sub_block_size)
        filled = cut_lineage(fill_block(state, length, done, step, cfg, proposer, keep))
        blocks.append(block_slots(filled, done))
        _logged(blocks[-1], log, step, sub_blocks)
        passes = filled.agg(F.max("passes").alias("n")).first()["n"]
        if passes is None:
            break
        step += passes * sub_blocks
        done += length
        state = filled.where("eos IS NULL").select("seq_id", "seen")
    return blocks


def fill(
    prompts: DataFrame,
    scores: DataFrame | None,
    suppressed: DataFrame,
    cfg: PrepConfig,
    log: str | None = None,
    scorer: Backoff | Callable | None = None,
) -> DataFrame:
    """Fill up to ``cfg.max_new_tokens`` slots behind each prompt (seq_id, input_ids).

    ``scorer`` says what a slot may hold: a ``Backoff`` table that looks at visible neighbours on
    both sides, or a model (tokens, query, upto) -> (token ids, logits) that sees the sequence,
    see ``FromModel``; without one, ``scores`` (ctx, token_id, logit) by the token in front.

    Returns (seq_id, pos, token_id, step), trimmed behind the first complete EOS; ``step`` says
    when a slot was filled, so every intermediate state can be read off the result.  A sequence
    is one row with its block as an array, and a block of all sequences is one projection and
    one checkpoint; the number of jobs depends on the settings only.  Candidate tables beyond
    ``BROADCAST_ROWS`` are joined by shuffle instead, with slots as rows, to the same result.  With
    ``log``, the slots that each pass filled are also written to a folder of the pass, block by
    block, which a reader may tail as a stream.
    """
    spark = prompts.sparkSession
    kind = prompts.schema["seq_id"].dataType.simpleString()
    heads = prompts.select("seq_id", F.coalesce("input_ids", F.array()).cast("array<int>").alias("seen"))
    blocks: list[DataFrame] = []
    if scorer is None:
        scorer = Backoff.of_scores(scores)
    if isinstance(scorer, Backoff):
        candidates = prepare_candidates(scorer, suppressed, cfg)
        tail = F.least(F.lit(scorer.reach), F.size("seen"))
        heads = heads.withColumn("seen", F.when(tail > 0, F.slice("seen", -tail, tail)).otherwise(F.array().cast("array<int>")))
        if candidates.small:
            automaton = Automaton(candidates.table.orderBy("depth", "ctx", "cell").toArrow(), scorer.path)
            shared = spark.sparkContext.broadcast(FromTable(automaton, cfg))
            blocks = _fill_packed(heads, lambda: shared.value, cfg, log, scorer.reach)
        else:
            blocks = _fill_rows(heads, candidates, cfg, log)
    else:
        model = FromModel(scorer, [r["token_id"] for r in suppressed.collect()], cfg)
        blocks = _fill_packed(heads, lambda: model, cfg, log, None)
    if not blocks:
        return spark.createDataFrame([], f"seq_id {kind}, pos int, token_id int, step int")
    filled = blocks[0]
    for block in blocks[1:]:
        filled = filled.unionByName(block)
    return filled if not isinstance(scorer, Backoff) or candidates.small else trim_at_eos(filled, cfg)


def trim_at_eos(slots: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Drop what stands behind the first complete EOS of each sequence."""
    if cfg.eos_id is None:
        return slots
    return (
        slots.join(complete_eos(slots, cfg), "seq_id", "left")
        .where(F.col("eos_pos").isNull() | (F.col("pos") <= F.col("eos_pos")))
        .drop("eos_pos")
    )


def state_log(filled: DataFrame) -> DataFrame:
    """(seq_id, step, pos, token_id): which slots each step filled."""
    return filled.where(F.col("step").isNotNull()).select("seq_id", "step", "pos", "token_id")


def state_at(filled: DataFrame, step: int, cfg: PrepConfig) -> DataFrame:
    """The slots as they stood after a step."""
    known = F.col("step").isNotNull() & (F.col("step") <= step)
    return filled.withColumn(
        "token_id", F.when(known, F.col("token_id")).otherwise(F.lit(cfg.mask_id))
    )


def sequence_ids(filled: DataFrame) -> DataFrame:
    """Filled slots as one list per sequence, at most ``max_new_tokens`` long."""
    return (
        filled.groupBy("seq_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("s"))
        .select("seq_id", F.transform("s", lambda s: s["token_id"]).alias("input_ids"))
    )


def response_only(slots: DataFrame, prompt_lengths: DataFrame) -> DataFrame:
    """Drop the prompt part of whole sequences: rows in front of ``prompt_len``."""
    return (
        slots.join(prompt_lengths.select("seq_id", "prompt_len"), "seq_id")
        .where(F.col("pos") >= F.col("prompt_len"))
        .drop("prompt_len")
    )


def render_state(slots: DataFrame, vocab: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Add ``shown``: the token text, ``[MASK]`` for open slots, nothing for special tokens."""
    names = vocab.select("token_id", "token", "is_special")
    shown = (
        F.when(F.col("token_id") == cfg.mask_id, "[MASK]")
        .when(F.col("is_special"), "")
        .otherwise(F.coalesce("token", F.lit("")))
    )
    return named_join(slots, names, "token_id", cfg).withColumn("shown", shown).drop("token", "is_special")


def slot_score(slots: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Add ``score``: the highlight value of a slot."""
    return slots.withColumn(
        "score", F.when(F.col("token_id") == cfg.mask_id, 0.5).otherwise(-0.5)
    )
