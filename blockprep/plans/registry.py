"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockprep.config import PrepConfig
from blockprep.functions.arrays import block_of, pad_block, prefix_visible_upto, truncate
from blockprep.functions.text import norm_role, render_chat, split_tokens, strip
from blockprep.operators import alias, backoff, filling, heavy, history, messages, packing, scores, tokens, views, vocabulary
from blockprep.operators.backoff import Backoff
from blockprep.plans import prepare
from blockprep.plans.answer import answers
from blockprep.sources.arrays import read_json_array
from blockprep.sources.instructions import load_instructions, read_dataset, read_instructions, write_jsonl
from blockprep.sources.prepared import check_manifest, write_views
from blockprep.sources.storage import cut_lineage, deal, new_path, spread
from blockprep.streaming import ingest
from blockprep.streaming import packing as stream_packing

CFG = PrepConfig(context_length=512, micro_batch=2, vocab_size=20_000)
STEPS, ACCUMULATION = 1500, 4
TOP_P, TEMPERATURE = 0.8, 0.7
STEP_THRESHOLD = 0.2
FOLD_PIECE = 4
#: Views whose slots one task sorts: some 500 bytes a slot.
TASK_VIEWS = 1024
EXTRA_TOKEN = "<|tool|>"
KEY = T.StructField("sample_id", T.LongType())

Query = Callable[[SparkSession, str], DataFrame]


# --- inputs -----------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def conversation_messages(spark: SparkSession, folder: str) -> DataFrame:
    return messages.turn_rows(table(spark, folder, "conversations"))


def turn_vocab(turns: DataFrame) -> DataFrame:
    """Counting needs no order, so the turns are not numbered for it."""
    return prepare.corpus_vocab(
        spread(turns).select("role", F.col("text").alias("content")), CFG
    )


def instruction_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as instruction rows, a third in each of the three shapes."""
    shape = F.pmod("doc_id", F.lit(3))
    null = F.lit(None).cast("string")

    def turn(role, source, content, value):
        return F.struct(
            role.alias("role"), source.alias("from"), content.alias("content"), value.alias("value")
        )

    lines = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.struct(
            F.when(F.pmod(i, F.lit(2)) == 0, "user").otherwise("assistant").alias("role"),
            F.nullif(line, F.lit("")).alias("content"),
        ),
    )
    turns = F.array(
        turn(null, F.lit("human"), F.lit(""), F.col("lang")),
        turn(F.lit("gpt"), F.lit("human"), F.col("text"), null),
        turn(null, null, null, F.col("source")),
    )
    return spread(table(spark, folder, "documents")).select(
        F.col("doc_id").alias("sample_id"),
        F.when(shape == 0, lines).alias("messages"),
        F.when(shape == 1, turns).alias("conversations"),
        F.when(F.col("lang") == "en", "").otherwise(F.col("source")).alias("instruction"),
        F.col("text").alias("prompt"),
        F.when(F.col("source") == "src0", "").otherwise(F.col("lang")).alias("input"),
        F.col("source").alias("answer"),
    )


def chat_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations with commands and blank texts typed in by some users."""
    user, c, t = F.col("role") == "user", F.col("conv_id"), F.col("turn")
    typed = (
        F.when(user & (c % 10 == 0) & (t >= 5), "EXIT")
        .when(user & (c % 3 == 0) & (t == 3), " Clear\n")
        .when(user & (c % 7 == 0) & (t == 2), " \t")
        .otherwise(F.col("text"))
    )
    return table(spark, folder, "conversations").withColumn("text", typed)


def vocab(spark: SparkSession, folder: str) -> DataFrame:
    return turn_vocab(table(spark, folder, "conversations"))


def ids(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return tokens.tokenize(messages.turn_rows(turns), turn_vocab(turns), CFG)


def batches(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    population = turns.select(F.col("conv_id").alias("sample_id")).distinct()
    return prepare.batches(
        messages.turn_rows(turns), turn_vocab(turns), CFG, population=population
    )


def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(batches(spark, folder), CFG)


def masked_views(spark: SparkSession, folder: str) -> DataFrame:
    return views.complementary_views(packed(spark, folder), CFG)


def pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    return scores.context_counts(views.training_pairs(masked_views(spark, folder)))


def allowed_scores(spark: SparkSession, folder: str) -> DataFrame:
    special = vocabulary.suppressed_ids(vocabulary.special_tokens(spark), CFG)
    return scores.suppress(scores.context_scores(pair_counts(spark, folder)), special)


def context_probs(spark: SparkSession, folder: str) -> DataFrame:
    return scores.softmax(scores.scale(allowed_scores(spark, folder), TEMPERATURE), ["ctx"])


def order_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of an order as candidates; summed first, so an order has one row per line number."""
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey", F.col("l_linenumber").alias("token_id"))
        .agg((F.sum("l_quantity") / 10).alias("logit"))
    )


def order_probs(spark: SparkSession, folder: str) -> DataFrame:
    return scores.softmax(order_scores(spark, folder), ["l_orderkey"])


def long_ids(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("input_ids").alias("pos", "token_id"))


def nine(column: str = "prob"):
    return F.round(column, 9).alias(column)


# --- rows to messages -------------------------------------------------------


def to_messages(spark, folder):
    return messages.message_rows(messages.to_messages(instruction_rows(spark, folder)))


def render(spark, folder):
    text = render_chat("messages")
    return messages.to_messages(instruction_rows(spark, folder)).select(
        "sample_id", F.length(text).alias("n_chars"), F.md5(text).alias("digest")
    )


def role_norm(spark, folder):
    given = (
        F.when(F.col("role") == "user", "human")
        .when(F.col("role") == "assistant", "gpt")
        .otherwise("tool")
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", norm_role(given).alias("role"))


def non_blank(spark, folder):
    rows = messages.non_blank(chat_turns(spark, folder), "text")
    return rows.select("conv_id", "turn", strip("text").alias("text"))


def pairs_to_messages(spark, folder):
    """Lines of a document as (user, assistant) pairs, its source as the new text."""
    lines = F.split("text", "\n", -1)
    asked = F.filter(lines, lambda _x, i: F.pmod(i, F.lit(2)) == 0)
    told = F.filter(lines, lambda _x, i: F.pmod(i, F.lit(2)) == 1)
    pairs = F.zip_with(
        asked,
        told,
        lambda u, a: F.struct(u.alias("user"), F.coalesce(a, F.lit("")).alias("assistant")),
    )
    history_rows = spread(table(spark, folder, "documents")).select(
        F.col("doc_id").alias("sample_id"), pairs.alias("history"), "source"
    )
    return messages.message_rows(
        messages.pairs_to_messages(history_rows, "history", "source", ["sample_id"])
    )


def prompt_messages(spark, folder):
    prompts = messages.prompt_messages(table(spark, folder, "benchmark"), "text", ["item_id"])
    return prompts.select("item_id", render_chat("messages", True).alias("text"))


def fold_turns(spark, folder):
    folded = messages.fold_turns(table(spark, folder, "conversations"), piece=FOLD_PIECE)
    return folded.select("conv_id", "piece", F.posexplode("messages").alias("pos", "m")).select(
        "conv_id", "piece", "pos", "m.role", "m.content"
    )


def history_prompts(spark, folder):
    return history.history_prompts(chat_turns(spark, folder))


def history_messages(spark, folder):
    return history.history_messages(chat_turns(spark, folder)).select(
        "conv_id", "epoch", "turn", "ord", "role", "content"
    )


# --- tokens -----------------------------------------------------------------


def token_split(spark, folder):
    split = spread(table(spark, folder, "documents")).select(
        "doc_id", "text", split_tokens("text", CFG).alias("t")
    )
    return split.select(
        "doc_id",
        F.size("t").alias("n_tokens"),
        (F.array_join("t", "") == F.col("text")).alias("lossless"),
        F.md5(F.array_join("t", "\u0001")).alias("digest"),
    )


def build_vocab(spark, folder):
    return prepare.corpus_vocab(to_messages(spark, folder), CFG)


def ensure_token(spark, folder):
    return vocabulary.ensure_token(vocab(spark, folder), EXTRA_TOKEN)


def suppressed_ids(spark, folder):
    return vocabulary.suppressed_ids(vocab(spark, folder), CFG)


def token_ids(spark, folder):
    return long_ids(ids(spark, folder), "sample_id")


def instruction_ids(spark, folder):
    rows = to_messages(spark, folder)
    coded = tokens.tokenize(rows, prepare.corpus_vocab(rows, CFG), CFG)
    return coded.select(
        "sample_id",
        F.size("input_ids").alias("n_ids"),
        F.md5(F.array_join(F.transform("input_ids", lambda t: t.cast("string")), " ")).alias("digest"),
    )


def append_eos(spark, folder):
    return ids(spark, folder).select(
        "sample_id",
        F.size("input_ids").alias("n_ids"),
        F.element_at("input_ids", -1).alias("last_id"),
    )


def pad_block_query(spark, folder):
    padded = pad_block(truncate("input_ids", CFG.context_length), CFG.block_size, CFG.mask_id)
    return ids(spark, folder).select(
        "sample_id",
        F.size(padded).alias("padded_len"),
        F.size(F.filter(padded, lambda t: t == CFG.mask_id)).alias("mask_tokens"),
    )


def prompt_ids(spark, folder):
    prompts = benchmark_prompts(spark, folder)
    return long_ids(tokens.prompt_ids(prompts, vocab(spark, folder), CFG), "sample_id")


def detokenize(spark, folder):
    return tokens.detokenize(packed(spark, folder), vocab(spark, folder), CFG, ["batch_id"])


# --- batches and views ------------------------------------------------------


def assign_batches(spark, folder):
    samples = table(spark, folder, "documents").select(F.col("doc_id").alias("sample_id"))
    return packing.assign_batches(samples, CFG)


def step_plan(spark, folder):
    samples = table(spark, folder, "documents").select(F.col("doc_id").alias("sample_id"))
    return packing.step_plan(samples, CFG, STEPS, ACCUMULATION)


def pack_offsets(spark, folder):
    return packing.pack_offsets(batches(spark, folder), CFG)


def pack_context(spark, folder):
    return long_ids(packed(spark, folder), "batch_id")


def mask_coins(spark, folder):
    coins = views.mask_coins(packed(spark, folder), CFG)
    return coins.select("batch_id", F.posexplode("coins").alias("pos", "coin"))


def complementary_views(spark, folder):
    return views.view_positions(masked_views(spark, folder))


def flatten_views(spark, folder):
    contexts = views.mask_coins(packed(spark, folder), CFG)
    stacked = contexts.select("batch_id", views.stacked_labels(CFG).alias("labels"))
    flat = views.flatten_views(stacked, ["batch_id"], "labels")
    return flat.select("batch_id", "view", F.posexplode("labels").alias("pos", "label"))


def training_pairs(spark, folder):
    return views.training_pairs(masked_views(spark, folder))


def batch_profile(spark, folder):
    return views.batch_profile(masked_views(spark, folder), CFG)


def block_visibility(spark, folder):
    seen = views.attach_visibility(masked_views(spark, folder), CFG)
    return seen.select("batch_id", "view", F.posexplode("visible_upto").alias("pos", "visible_upto"))


def prefix_visibility(spark, folder):
    """Filling-time visibility of each sample, its last block being the current one."""
    samples = packing.pad_samples(batches(spark, folder), CFG)
    return samples.select(
        "sample_id", F.size("input_ids").alias("n"), F.posexplode("input_ids").alias("pos", "_t")
    ).select(
        "sample_id", "pos", prefix_visible_upto("pos", F.col("n"), CFG.block_size).alias("visible_upto")
    )


# --- scores -----------------------------------------------------------------


def context_counts(spark, folder):
    return pair_counts(spark, folder)


def suppress(spark, folder):
    return allowed_scores(spark, folder).select("ctx", "token_id", nine("logit"))


def softmax(spark, folder):
    probs = scores.softmax(allowed_scores(spark, folder), ["ctx"])
    return probs.select("ctx", "token_id", nine())


def argmax(spark, folder):
    return scores.argmax(allowed_scores(spark, folder), ["ctx"]).select(
        "ctx", "token_id", nine("logit")
    )


def nucleus(spark, folder):
    kept = scores.nucleus(context_probs(spark, folder), ["ctx"], TOP_P)
    return kept.select("ctx", "token_id", nine())


def weighted_draw(spark, folder):
    kept = scores.nucleus(context_probs(spark, folder), ["ctx"], TOP_P)
    return scores.weighted_draw(kept, ["ctx"], CFG.seed).select("ctx", "token_id", nine())


def gather(spark, folder):
    allowed = allowed_scores(spark, folder)
    chosen = scores.argmax(allowed, ["ctx"])
    probs = scores.softmax(allowed, ["ctx"])
    return scores.gather(probs, chosen, ["ctx"]).select("ctx", "token_id", nine())


def scatter(spark, folder):
    probs = context_probs(spark, folder)
    kept = scores.nucleus(probs, ["ctx"], TOP_P)
    return scores.scatter(probs, kept, ["ctx"]).select("ctx", "token_id", nine())


def order_softmax(spark, folder):
    return order_probs(spark, folder).select("l_orderkey", "token_id", nine())


def order_argmax(spark, folder):
    return scores.argmax(order_scores(spark, folder), ["l_orderkey"])


def order_nucleus(spark, folder):
    kept = scores.nucleus(order_probs(spark, folder), ["l_orderkey"], TOP_P)
    return kept.select("l_orderkey", "token_id", nine())


def order_draw(spark, folder):
    drawn = scores.weighted_draw(order_probs(spark, folder), ["l_orderkey"], CFG.seed)
    return drawn.select("l_orderkey", "token_id", nine())


# --- filling ----------------------------------------------------------------


def stored_views(spark: SparkSession, folder: str) -> DataFrame:
    """The views as a written table: counting and filling both read them."""
    path = new_path(spark, "views")
    write_views(masked_views(spark, folder), path, CFG)
    return spark.read.parquet(path)


def dealt_views(stored: DataFrame) -> DataFrame:
    """Each view as a sequence, placed before its slots are rows, and few in a task."""
    named = stored.select((F.col("batch_id") * 2 + F.col("view")).alias("seq_id"), "input_ids")
    return deal(named, ["seq_id"], -(-stored.count() // TASK_VIEWS))


def view_slots(stored: DataFrame) -> DataFrame:
    """Both views of each context as slots to fill; each view is a sequence."""
    return dealt_views(stored).select("seq_id", F.posexplode("input_ids").alias("pos", "token_id"))


def scored_slots(stored: DataFrame) -> DataFrame:
    """Per position, the pick and share computed from its own token."""
    spark = stored.sparkSession
    picks = filling.greedy_picks(
        scores.context_scores(scores.context_counts(views.training_pairs(stored))),
        vocabulary.suppressed_ids(vocabulary.special_tokens(spark), CFG),
    )
    known = F.broadcast(
        picks.select(F.col("ctx").alias("own"), F.col("token_id").alias("candidate"), "prob")
    )
    slots = view_slots(stored)
    return slots.join(known, slots["token_id"] == known["own"], "left").select(
        "seq_id",
        "pos",
        "token_id",
        F.coalesce("candidate", F.lit(CFG.unknown_id)).alias("candidate"),
        F.coalesce("prob", F.lit(0.0)).alias("prob"),
    )


def shifted_slots(stored: DataFrame) -> DataFrame:
    return scores.shift_scores(scored_slots(stored), ["candidate", "prob"])


def chosen_slots(stored: DataFrame) -> DataFrame:
    slots = shifted_slots(stored).withColumns(
        {
            "masked": F.col("token_id") == CFG.mask_id,
            "sub_block": F.floor(F.col("pos") / CFG.sub_block_size),
        }
    )
    return scores.select_confident(slots, STEP_THRESHOLD)


def open_slots(stored: DataFrame) -> DataFrame:
    """The views as a step takes them; the first slot of a context is scored by itself."""
    first = F.element_at("input_ids", 1)
    return dealt_views(stored).select(
        "seq_id",
        F.array(first).alias("seen"),
        F.lit(None).cast("int").alias("step"),
        F.lit(False).alias("finished"),
        F.posexplode("input_ids").alias("pos", "token_id"),
    )


def stepped_slots(stored: DataFrame) -> DataFrame:
    """One filling step on all sub-blocks of all views."""
    counted = scores.context_scores(scores.context_counts(views.training_pairs(stored)))
    special = vocabulary.suppressed_ids(vocabulary.special_tokens(stored.sparkSession), CFG)
    candidates = filling.prepare_candidates(Backoff.of_scores(counted), special, CFG, spare=(CFG.unknown_id, 0.0))
    return filling.fill_step(open_slots(stored), candidates, replace(CFG, threshold=STEP_THRESHOLD), 0, 0)


def filled_slots(spark: SparkSession, folder: str) -> DataFrame:
    return stepped_slots(stored_views(spark, folder)).select("seq_id", "pos", "token_id")


def filled_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The filled slots with every block as a sequence of its own; view 0 is closed by the guard."""
    per_context = CFG.context_length // CFG.block_size
    block = block_of("pos", CFG.block_size)
    slots = filled_slots(spark, folder).withColumn("finished", F.pmod("seq_id", F.lit(2)) == 1)
    return filling.fill_leftovers(slots, CFG).select(
        (F.col("seq_id") * per_context + block).alias("seq_id"), "pos", "token_id"
    )


def shift_scores(spark, folder):
    return shifted_slots(stored_views(spark, folder)).select("seq_id", "pos", "candidate", nine())


def select_confident(spark, folder):
    return chosen_slots(stored_views(spark, folder)).where("masked").select("seq_id", "sub_block", "pos", "chosen")


def fill_step(spark, folder):
    return filled_slots(spark, folder)


def apply_fills(spark, folder):
    """The same step with the fills written back by a join."""
    stored = stored_views(spark, folder)
    chosen = chosen_slots(stored).where("chosen")
    fills = chosen.select("seq_id", "pos", F.col("candidate").alias("token_id"))
    return filling.apply_fills(view_slots(stored), fills)


def complete_eos(spark, folder):
    return filling.complete_eos(filled_blocks(spark, folder), CFG)


def has_mask(spark, folder):
    return filling.has_mask(filled_slots(spark, folder), CFG)


def fill_leftovers(spark, folder):
    slots = filled_slots(spark, folder).withColumn("finished", F.lit(False))
    return filling.fill_leftovers(slots, CFG).select("seq_id", "pos", "token_id")


def trim_at_eos(spark, folder):
    return filling.trim_at_eos(filled_blocks(spark, folder), CFG)


def response_only(spark, folder):
    """Contexts without their first sample."""
    slots = long_ids(packed(spark, folder), "batch_id").withColumnRenamed("batch_id", "seq_id")
    lengths = packing.pack_offsets(batches(spark, folder), CFG).where("slot = 0").select(
        F.col("batch_id").alias("seq_id"), F.col("padded_len").alias("prompt_len")
    )
    return filling.response_only(slots, lengths)


def render_state(spark, folder):
    shown = filling.render_state(view_slots(masked_views(spark, folder)), vocab(spark, folder), CFG)
    return filling.slot_score(shown, CFG).select("seq_id", "pos", "shown", "score")


def benchmark_prompts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark").withColumnRenamed("item_id", "sample_id")
    return messages.prompt_messages(rows, "text", ["sample_id"])


def fitted(spark: SparkSession, folder: str, cfg: PrepConfig) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and score table (context counts) of the conversations."""
    rows = conversation_messages(spark, folder)
    known = prepare.freeze_vocab(rows, cfg, new_path(spark, "vocab"))
    return known, prepare.fit_scores(rows, known, cfg)


FILL_CFG = replace(CFG, block_size=8, sub_block_size=4, max_new_tokens=12, threshold=0.3)
SIDES = (-1, -2, 1)


def benchmark_heads(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    coded = tokens.prompt_ids(benchmark_prompts(spark, folder), known, CFG)
    return coded.withColumnRenamed("sample_id", "seq_id")


def _fill(spark: SparkSession, folder: str, cfg: PrepConfig) -> DataFrame:
    """Answers to the benchmark texts, filled from the context counts of the conversations."""
    known, table_of_scores = fitted(spark, folder, CFG)
    heads = benchmark_heads(spark, folder, known)
    return filling.fill(heads, table_of_scores, vocabulary.suppressed_ids(known, CFG), cfg)


def fill_final(spark, folder):
    return _fill(spark, folder, FILL_CFG)


def fill_sampled(spark, folder):
    return _fill(spark, folder, replace(FILL_CFG, temperature=1.0))


def sequence_fit(spark: SparkSession, folder: str) -> tuple[DataFrame, Backoff]:
    """Vocabulary and a backoff over two tokens in front and one behind."""
    rows = conversation_messages(spark, folder)
    known = prepare.freeze_vocab(rows, CFG, new_path(spark, "vocab"))
    stored = new_path(spark, "views")
    write_views(prepare.views(rows, known, CFG), stored, CFG)
    return known, Backoff.fit(spark.read.parquet(stored), CFG, SIDES)


def fill_sequence(spark, folder):
    """The same with slots scored by what they see on both sides."""
    known, scorer = sequence_fit(spark, folder)
    special = vocabulary.suppressed_ids(known, CFG)
    return filling.fill(benchmark_heads(spark, folder, known), None, special, FILL_CFG, scorer=scorer)


def fill_sequence_sampled(spark, folder):
    known, scorer = sequence_fit(spark, folder)
    special = vocabulary.suppressed_ids(known, CFG)
    cfg = replace(FILL_CFG, temperature=1.0)
    return filling.fill(benchmark_heads(spark, folder, known), None, special, cfg, scorer=scorer)


def copy_model(tokens_seen, _query, upto):
    """A model of the caller's: what a text has said before, late words first."""
    visible = tokens_seen[:upto]
    places = dict(zip(visible.tolist(), range(len(visible))))
    return list(places), [at / len(visible) for at in places.values()]


def fill_by_model(spark, folder):
    """Filling driven by a caller's model instead of a table."""
    known = prepare.freeze_vocab(conversation_messages(spark, folder), CFG, new_path(spark, "vocab"))
    special = vocabulary.suppressed_ids(known, CFG)
    heads = benchmark_heads(spark, folder, known)
    return filling.fill(heads, None, special, replace(FILL_CFG, threshold=0.003), scorer=copy_model)


def context_backoff(spark, folder):
    """Counts of the contexts of every depth, as text keys."""
    counted = backoff.count_contexts(masked_views(spark, folder), CFG, SIDES)
    return counted.select("depth", F.array_join(F.transform("ctx", lambda t: t.cast("string")), ",").alias("ctx"), "label", "n")


def alias_tables(spark, folder):
    kept = scores.nucleus(context_probs(spark, folder), ["ctx"], TOP_P)
    made = alias.alias_tables(kept, ["ctx"])
    return made.select("ctx", "size", "cell", "token_id", nine(), nine("accept"), "alias_id", nine("alias_prob"))


def order_alias(spark, folder):
    made = alias.alias_tables(order_probs(spark, folder), ["l_orderkey"])
    return made.select("l_orderkey", "size", "cell", "token_id", nine("accept"), "alias_id")


def answer_texts(spark, folder):
    """Sampled answers as texts."""
    cfg = replace(FILL_CFG, temperature=1.0)
    known, table_of_scores = fitted(spark, folder, CFG)
    return answers(benchmark_prompts(spark, folder), known, table_of_scores, cfg)


# --- files and streams ------------------------------------------------------


def instructions_round_trip(spark, folder):
    path = new_path(spark, "rows")
    write_jsonl(instruction_rows(spark, folder), path)
    back = read_instructions(spark, path, keys=[KEY])
    return messages.message_rows(messages.to_messages(back))


def rows_without_ids(spark, folder):
    """Instruction files as most come: no id column; ids are made from the content."""
    path = new_path(spark, "rows")
    write_jsonl(instruction_rows(spark, folder).drop("sample_id"), path)
    rows = messages.with_sample_ids(read_instructions(spark, path))
    return messages.to_messages(rows).select(
        F.md5(render_chat("messages")).alias("digest"),
        F.substring_index("sample_id", "-", -1).cast("long").alias("copy"),
        F.length(F.substring_index("sample_id", "-", 1)).alias("id_chars"),
    )


def rejected_lines(spark, folder):
    """Lines that are JSON but no objects, or no JSON, between good ones."""
    path, doc = new_path(spark, "lines"), table(spark, folder, "documents")
    kind = F.pmod("doc_id", F.lit(5))
    good = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("lang").alias("answer")))
    line = F.when(kind == 0, "123").when(kind == 1, '"txt"').when(kind == 2, "[1]").when(kind == 3, "{broken")
    doc.select(F.coalesce(line, good).alias("value")).write.text(path)
    rows = read_instructions(spark, path)
    refused = messages.rejected_rows(rows).groupBy(F.col("_corrupt_record").alias("line")).agg(F.count(F.lit(1)).alias("n"))
    taken = messages.to_messages(rows, keys=[]).agg(F.count(F.lit(1)).alias("n"))
    return refused.unionByName(taken.select(F.lit("taken").alias("line"), "n"))


def lossless_ids(spark, folder):
    """Documents to ids and back, whole, with a vocabulary that lacks most of their tokens."""
    cfg = replace(CFG, vocab_size=300, context_length=2**31 - 1)
    docs = spread(table(spark, folder, "documents")).select("doc_id", "text")
    counted = docs.select(F.explode(split_tokens("text", cfg)).alias("token")).groupBy("token")
    known = cut_lineage(vocabulary.build_vocab(counted.agg(F.count(F.lit(1)).alias("n")), cfg))
    rows = docs.select(
        F.col("doc_id").alias("sample_id"), F.lit(0).alias("ord"), F.lit("user").alias("role"), F.col("text").alias("content")
    )
    back = tokens.detokenize(tokens.token_ids(rows, known, cfg), known, cfg, ["sample_id"])
    return back.select("sample_id", F.md5("text").alias("digest"))


def select_split(spark, folder):
    path = new_path(spark, "dataset")
    split = F.when(F.pmod("sample_id", F.lit(5)) == 0, "test").otherwise("train")
    write_jsonl(instruction_rows(spark, folder).withColumn("split", split), path, ["split"])
    rows = read_dataset(spark, path, "train", keys=[KEY])
    return messages.to_messages(rows).select(
        "sample_id", F.md5(render_chat("messages")).alias("digest")
    )


def stream_ingest(spark, folder):
    source, sink, state = (new_path(spark, name) for name in ("rows", "rendered", "state"))
    write_jsonl(instruction_rows(spark, folder), source)
    rows = ingest.stream_instructions(spark, source, [KEY], files_per_trigger=1)
    ingest.ingest_rendered(rows, ["sample_id"], sink, state).awaitTermination()
    return spark.read.parquet(sink).select(
        "sample_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest")
    )


def stream_views(spark, folder):
    source, sink, state, words = (new_path(spark, n) for n in ("rows", "views", "state", "vocab"))
    write_jsonl(instruction_rows(spark, folder), source)
    cfg = replace(CFG, micro_batch=1)
    prepare.freeze_vocab(to_messages(spark, folder), cfg, words)
    rows = ingest.stream_instructions(spark, source, [KEY], files_per_trigger=1)
    ingest.ingest_views(rows, words, cfg, sink, state).awaitTermination()
    stored = ingest.read_ingested_views(spark, sink)

    def digest(column):
        return F.md5(F.array_join(F.transform(column, lambda t: t.cast("string")), " "))

    return stored.select(
        F.col("batch_id").alias("sample_id"),
        "view",
        digest("input_ids").alias("inputs"),
        digest("labels").alias("labels"),
    )


# --- the same steps where files, hooks and settings come in ---------------------


def files_win(spark, folder):
    """Given both, data files are read and the dataset is not; without files, the split is."""
    dataset, files = new_path(spark, "dataset"), new_path(spark, "files")
    prompts = table(spark, folder, "benchmark").select(F.col("item_id").alias("sample_id"), F.col("text").alias("prompt"))
    write_jsonl(prompts.withColumn("split", F.lit("train")), dataset, ["split"])
    write_jsonl(instruction_rows(spark, folder), files)
    both = load_instructions(spark, dataset, "train", files, [KEY])
    alone = load_instructions(spark, dataset, "train", None, [KEY])

    def digests(rows, name):
        return messages.to_messages(rows).select(
            F.lit(name).alias("source"), "sample_id", F.md5(render_chat("messages")).alias("digest")
        )

    return digests(both, "files").unionByName(digests(alone, "dataset"))


def as_arrays(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a file that is one array of these objects, behind one of its own."""
    yield pa.RecordBatch.from_pydict({"value": ['[{"sample_id": -1, "prompt": "{[\\\\\\"}]"}']})
    yield from texts
    yield pa.RecordBatch.from_pydict({"value": ["]"]})


def large_array(spark, folder):
    """Documents as pretty-printed arrays, one array a file and a task, read by byte ranges."""
    path = new_path(spark, "array")
    rows = instruction_rows(spark, folder)
    body = F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"})
    lines = rows.select(F.concat(F.lit(","), body).alias("value"))
    lines.mapInArrow(as_arrays, "value string").write.text(path)
    read = read_json_array(spark, path, [KEY]).where("sample_id >= 0")
    return messages.to_messages(read).select("sample_id", F.md5(render_chat("messages")).alias("digest"))


def saved_count(spark, folder):
    """What writing reports, and what is there to read."""
    path = new_path(spark, "rows")
    saved = write_jsonl(instruction_rows(spark, folder), path)
    read = read_instructions(spark, path, keys=[KEY]).agg(F.count(F.lit(1)).alias("n_read"))
    return read.select(F.lit(saved).cast("long").alias("n_saved"), "n_read")


def prepared_epochs(spark: SparkSession, folder: str) -> str:
    path = new_path(spark, "prepared")
    rows = conversation_messages(spark, folder)
    for epoch in (0, 1):
        prepare.prepare(rows, CFG, path, epoch)
    return path


def stored_epochs(spark, folder):
    """Two epochs prepared after each other, read back from one store."""
    stored = spark.read.parquet(f"{prepared_epochs(spark, folder)}/views")
    return views.view_positions(stored, ("epoch", "batch_id", "view"))


def stamp_check(spark, folder):
    """Which settings a stored preparation fits, with the views found in it."""
    path = f"{prepared_epochs(spark, folder)}/views"
    cases = {
        "same": CFG,
        "other mask": replace(CFG, mask_id=9),
        "other block": replace(CFG, block_size=16),
        "other base": replace(CFG, base_name="else"),
    }
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        fits = {name: check_manifest(spark, path, cfg) for name, cfg in cases.items()}
        fits["no stamp"] = check_manifest(spark, new_path(spark, "nothing"), CFG)
    known = F.explode(F.array(*[F.struct(F.lit(k).alias("settings"), F.lit(v).alias("fits")) for k, v in fits.items()]))
    found = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_views"))
    return found.select("n_views", known.alias("c")).select("n_views", "c.settings", "c.fits")


def supplied_vocab(spark: SparkSession, folder: str) -> tuple[DataFrame, PrepConfig]:
    """A vocabulary from elsewhere, with pad and begin tokens of its own and no mask."""
    own = vocab(spark, folder).where(F.col("token") != CFG.mask_token)
    own = vocabulary.ensure_token(vocabulary.ensure_token(own, "<pad>"), "<s>")
    known, cfg = vocabulary.bind_vocab(cut_lineage(own), CFG)
    ids = dict(known.where(F.col("token").isin("<pad>", "<s>")).select("token", "token_id").collect())
    return known, replace(cfg, pad_id=ids["<pad>"], bos_id=ids["<s>"])


def supplied_ids(spark, folder):
    """The suppressed ids of a supplied vocabulary, as the one list a sampler takes."""
    known, cfg = supplied_vocab(spark, folder)
    listed = vocabulary.id_list(vocabulary.suppressed_ids(known, cfg))
    return listed.select(F.array_join(F.transform("token_ids", lambda t: t.cast("string")), " ").alias("ids"))


def supplied_token_ids(spark, folder):
    """Conversations in the ids of a supplied vocabulary."""
    known, cfg = supplied_vocab(spark, folder)
    coded = tokens.tokenize(conversation_messages(spark, folder), known, cfg)
    return coded.select("sample_id", F.md5(F.array_join(F.transform("input_ids", lambda t: t.cast("string")), " ")).alias("digest"))


def guard_pad(spark, folder):
    """The guard's spare id: end-of-sequence, which is also the pad id unless one is named."""
    slots = filled_slots(spark, folder).withColumn("finished", F.lit(False))
    cases = {"default": CFG, "pad": replace(CFG, eos_id=None, pad_id=7), "pad beside end": replace(CFG, pad_id=7)}
    out = None
    for name, cfg in cases.items():
        part = filling.fill_leftovers(slots, cfg).select(
            F.lit(name).alias("settings"), F.lit(cfg.padding_id).alias("pad_id"), "seq_id", "pos", "token_id"
        )
        out = part if out is None else out.unionByName(part)
    return out


def append_block(spark, folder):
    """A block of open slots behind each prompt."""
    known = prepare.freeze_vocab(conversation_messages(spark, folder), CFG, new_path(spark, "vocab"))
    heads = benchmark_heads(spark, folder, known).select("seq_id", F.col("input_ids").alias("seen"))
    made = filling.append_block(heads, FILL_CFG.block_size, FILL_CFG.max_new_tokens - FILL_CFG.block_size, FILL_CFG)
    return made.select("seq_id", "pos", "token_id", "finished", F.size("seen").alias("n_seen"))


def fill_log(spark, folder):
    """Which step filled which slot."""
    return filling.state_log(fill_sequence(spark, folder))


def fill_states(spark, folder):
    """The slots as they stood after some steps."""
    filled, out = cut_lineage(fill_sequence(spark, folder)), None
    for step in (0, 1, 3):
        part = filling.state_at(filled, step, FILL_CFG).select(F.lit(step).alias("after"), "seq_id", "pos", "token_id")
        out = part if out is None else out.unionByName(part)
    return out


def tailed_log(spark, folder):
    """The log of a run, followed as a stream."""
    known, table_of_scores = fitted(spark, folder, CFG)
    log, sink, state = (new_path(spark, n) for n in ("log", "tailed", "state"))
    heads = benchmark_heads(spark, folder, known)
    filling.fill(heads, table_of_scores, vocabulary.suppressed_ids(known, CFG), FILL_CFG, log=log)
    followed = ingest.tail_state_log(spark, log).writeStream.format("parquet").option("path", sink)
    followed.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).select("seq_id", "step", "pos", "token_id")


PACK_WIDTH, PACK_GROUPS, PACK_DELAY, PACK_START = "2 hours", 4, "30 days", 1_700_000_000


def stream_packed(spark, folder):
    """Samples packed two by two out of a stream of files that is stopped and started again."""
    names = ("rows", "samples", "contexts", "state", "state", "vocab")
    source, samples, sink, state, packing_state, words = (new_path(spark, n) for n in names)
    prepare.freeze_vocab(to_messages(spark, folder), CFG, words)
    at = F.timestamp_seconds(F.lit(PACK_START) + F.col("sample_id") * 60)
    timed = instruction_rows(spark, folder).withColumn("at", at)
    # The row that ends the stream is later than all others by more than the delay.
    last = timed.agg(F.max("sample_id").alias("sample_id"), F.max("at").alias("at")).select(
        (F.col("sample_id") + 1).alias("sample_id"), (F.col("at") + F.expr("INTERVAL 60 DAYS")).alias("at"), F.lit("end").alias("prompt")
    )
    for rows in (timed, last):
        rows.write.mode("append").option("ignoreNullFields", "false").json(source)
        timed_keys = [KEY, T.StructField("at", T.TimestampType())]
        arriving = ingest.stream_instructions(spark, source, timed_keys, files_per_trigger=3)
        stream_packing.ingest_samples(arriving, words, CFG, samples, state).awaitTermination()
        stream_packing.pack_stream(
            spark, samples, CFG, sink, packing_state, PACK_WIDTH, PACK_GROUPS, PACK_DELAY
        ).awaitTermination()
    digest = F.md5(F.array_join(F.transform("input_ids", lambda t: t.cast("string")), " "))
    return spark.read.parquet(sink).select("batch_id", F.size("input_ids").alias("n_ids"), digest.alias("digest"))


def stream_rejects(spark, folder):
    """Lines without a message form, set aside by a stream."""
    source, sink, state, bad = new_path(spark, "lines"), new_path(spark, "rejects"), new_path(spark, "state"), F.col("source")
    good = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("lang").alias("answer")))
    line = F.when(F.col("lang") == "en", good).otherwise(F.concat(F.lit("{broken "), bad))
    table(spark, folder, "documents").select(line.alias("value")).write.text(source)
    rows = ingest.stream_instructions(spark, source, [], files_per_trigger=1)
    ingest.ingest_rejects(rows, sink, state).awaitTermination()
    refused = spark.read.schema("_corrupt_record string").option("columnNameOfCorruptRecord", "_bad").json(sink)
    return refused.groupBy(F.col("_corrupt_record").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def byte_encoder(texts: list[str]) -> list[list[int]]:
    """A caller's tokenizer: bytes, behind the reserved ids."""
    return [[5 + b for b in text.encode()] for text in texts]


def hooked_ids(spark, folder):
    """Documents through a caller's tokenizer, cut and ended like others."""
    docs = spread(table(spark, folder, "documents")).select(F.col("doc_id").alias("sample_id"), "text")
    coded = tokens.tokenize_with(docs, byte_encoder, CFG)
    return coded.select(
        "sample_id",
        F.size("input_ids").alias("n_ids"),
        F.md5(F.array_join(F.transform("input_ids", lambda t: t.cast("string")), " ")).alias("digest"),
    )


#: Few frequent tokens are broadcast here, so that most are joined by shuffle.
HEAVY = 50


def heavy_lookup(spark, folder):
    """Every token of the documents against the conversations' vocabulary, frequent ones apart."""
    docs = spread(table(spark, folder, "documents"))
    rows = docs.select("doc_id", F.explode(split_tokens("text", CFG)).alias("token"))
    known = cut_lineage(vocab(spark, folder).select("token", "token_id"))
    met = heavy.heavy_join(rows, known, "token", HEAVY)
    return met.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count("token_id").alias("n_known"), F.sum(F.col("token_id").cast("long")).alias("id_sum")
    )


def large_vocab(spark, folder):
    """The vocabulary of the documents, numbered by ranges as one beyond the broadcast limit is."""
    docs = spread(table(spark, folder, "documents"))
    counted = docs.select(F.explode(split_tokens("text", CFG)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.build_vocab(counted, replace(CFG, vocab_size=5_000_000, byte_fallback=False))


QUERIES: dict[str, Query] = {
    "to_messages": to_messages,
    "render_chat": render,
    "role_norm": role_norm,
    "non_blank": non_blank,
    "pairs_to_messages": pairs_to_messages,
    "prompt_messages": prompt_messages,
    "fold_turns": fold_turns,
    "history_prompts": history_prompts,
    "history_messages": history_messages,
    "token_split": token_split,
    "build_vocab": build_vocab,
    "ensure_token": ensure_token,
    "suppressed_ids": suppressed_ids,
    "token_ids": token_ids,
    "instruction_ids": instruction_ids,
    "append_eos": append_eos,
    "pad_block": pad_block_query,
    "prompt_ids": prompt_ids,
    "detokenize": detokenize,
    "assign_batches": assign_batches,
    "step_plan": step_plan,
    "pack_offsets": pack_offsets,
    "pack_context": pack_context,
    "mask_coins": mask_coins,
    "complementary_views": complementary_views,
    "flatten_views": flatten_views,
    "training_pairs": training_pairs,
    "batch_profile": batch_profile,
    "block_visibility": block_visibility,
    "prefix_visibility": prefix_visibility,
    "context_counts": context_counts,
    "suppress": suppress,
    "softmax": softmax,
    "argmax": argmax,
    "nucleus": nucleus,
    "weighted_draw": weighted_draw,
    "gather": gather,
    "scatter": scatter,
    "order_softmax": order_softmax,
    "order_argmax": order_argmax,
    "order_nucleus": order_nucleus,
    "order_draw": order_draw,
    "shift_scores": shift_scores,
    "select_confident": select_confident,
    "fill_step": fill_step,
    "apply_fills": apply_fills,
    "complete_eos": complete_eos,
    "has_mask": has_mask,
    "fill_leftovers": fill_leftovers,
    "trim_at_eos": trim_at_eos,
    "response_only": response_only,
    "render_state": render_state,
    "fill_final": fill_final,
    "fill_sampled": fill_sampled,
    "fill_sequence": fill_sequence,
    "fill_sequence_sampled": fill_sequence_sampled,
    "fill_by_model": fill_by_model,
    "context_backoff": context_backoff,
    "alias_tables": alias_tables,
    "order_alias": order_alias,
    "answer_texts": answer_texts,
    "files_win": files_win,
    "large_array": large_array,
    "saved_count": saved_count,
    "stored_epochs": stored_epochs,
    "stamp_check": stamp_check,
    "supplied_ids": supplied_ids,
    "supplied_token_ids": supplied_token_ids,
    "guard_pad": guard_pad,
    "append_block": append_block,
    "fill_log": fill_log,
    "fill_states": fill_states,
    "tailed_log": tailed_log,
    "stream_rejects": stream_rejects,
    "stream_packed": stream_packed,
    "hooked_ids": hooked_ids,
    "heavy_lookup": heavy_lookup,
    "large_vocab": large_vocab,
    "instructions_round_trip": instructions_round_trip,
    "select_split": select_split,
    "rows_without_ids": rows_without_ids,
    "rejected_lines": rejected_lines,
    "lossless_ids": lossless_ids,
    "stream_ingest": stream_ingest,
    "stream_views": stream_views,
}
