"""The token-to-id table and the special ids in it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockprep.config import (
    BROADCAST_VOCAB,
    BYTE_NAME,
    EOS_TOKEN,
    FIRST_CORPUS_ID,
    MASK_TOKEN,
    SPECIAL_TOKENS,
    TURN_END,
    TURN_START,
    UNKNOWN_TOKEN,
    VOCAB_SCHEMA,
    PrepConfig,
)
from blockprep.operators.running import sorted_numbers
from blockprep.functions.text import render_message, split_tokens


def special_rows(cfg: PrepConfig) -> list[tuple[str, int]]:
    """The marks with their ids, as the settings have them."""
    own = {MASK_TOKEN: cfg.mask_id, EOS_TOKEN: cfg.eos_id, UNKNOWN_TOKEN: cfg.unknown_id}
    rows = [(cfg.mask_token if t == MASK_TOKEN else t, own.get(t, i)) for t, i in SPECIAL_TOKENS]
    return [(token, i) for token, i in rows if i is not None]


def special_tokens(spark: SparkSession, cfg: PrepConfig = PrepConfig()) -> DataFrame:
    return spark.createDataFrame([(t, i, True) for t, i in special_rows(cfg)], VOCAB_SCHEMA)


def byte_tokens(spark: SparkSession, cfg: PrepConfig) -> DataFrame:
    """A row for each byte, behind the places of the corpus tokens."""
    name = F.format_string(BYTE_NAME, F.lpad(F.hex("id"), 2, "0"))
    return spark.range(256).select(
        name.alias("token"),
        (F.col("id") + cfg.byte_base).cast("int").alias("token_id"),
        F.lit(False).alias("is_special"),
    )


def _id_rows(spark: SparkSession, ids: Sequence[int]) -> DataFrame:
    rows = ", ".join(f"({i})" for i in ids)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(token_id)")


def count_tokens(messages: DataFrame, cfg: PrepConfig) -> DataFrame:
    """(token, n) over the whole rendered text of all messages."""
    rendered = render_message("role", "content")
    return (
        messages.select(F.explode(split_tokens(rendered, cfg)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _frequent(counts: DataFrame, size: int) -> DataFrame:
    """At least the ``size`` most frequent tokens, and few others.

    Counts fall into classes by their binary length and leading digits (some
    2,000 classes; exact counts below 64).  Classes that lie behind ``size``
    more frequent tokens are left out, so that the top-k after this merges
    about ``size`` rows and not ``size`` rows from every partition.
    """
    digits = F.bin("n")
    head = F.conv(F.substring(digits, 1, 6), 2, 10).cast("int")
    classed = counts.withColumn("_class", F.length(digits) * 64 + head)
    before = W.partitionBy(F.lit(0)).orderBy(F.desc("_class")).rowsBetween(W.unboundedPreceding, -1)
    wanted = (
        classed.groupBy("_class")
        .agg(F.count(F.lit(1)).alias("_tokens"))
        .withColumn("_before", F.coalesce(F.sum("_tokens").over(before), F.lit(0)))
        .where(F.col("_before") < size)
        .select("_class")
    )
    return classed.join(F.broadcast(wanted), "_class", "left_semi").drop("_class")


def build_vocab(counts: DataFrame, cfg: PrepConfig) -> DataFrame:
    """The most frequent tokens with dense ids behind the reserved ones.

    Up to ``BROADCAST_VOCAB`` tokens are numbered in one task, which sees no more
    than that many short rows; a larger vocabulary is numbered by ranges.
    """
    reserved = [token for token, _ in special_rows(cfg)]
    corpus = _frequent(counts.where(~F.col("token").isin(reserved)), cfg.vocab_size)
    order = [F.desc("n"), F.col("token")]
    if cfg.vocab_size <= BROADCAST_VOCAB:
        top = corpus.orderBy(*order).limit(cfg.vocab_size)
        ranked = top.withColumn("_rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)) - 1)
    else:
        ranked = sorted_numbers(corpus, order, "_rank").where(F.col("_rank") < cfg.vocab_size)
    numbered = ranked.select(
        "token",
        (F.col("_rank") + FIRST_CORPUS_ID).cast("int").alias("token_id"),
        F.lit(False).alias("is_special"),
    )
    vocab = numbered.unionByName(special_tokens(counts.sparkSession, cfg))
    return vocab.unionByName(byte_tokens(counts.sparkSession, cfg)) if cfg.byte_fallback else vocab


def bind_vocab(vocab: DataFrame, cfg: PrepConfig) -> tuple[DataFrame, PrepConfig]:
    """A supplied vocabulary with its mask token, and settings with the ids it really has.

    The mask is added behind the highest id unless it is there.  End and unknown ids follow
    the rows of that name.  Byte rows serve if all 256 are there with ids one after the other;
    without them and without an unknown row, tokens outside the vocabulary would have no id,
    which is an error.
    """
    vocab = ensure_token(vocab, cfg.mask_token)
    byte_names = [BYTE_NAME % f"{b:02X}" for b in range(256)]
    wanted = [cfg.mask_token, EOS_TOKEN, UNKNOWN_TOKEN, *byte_names]
    found = dict(vocab.where(F.col("token").isin(wanted)).select("token", "token_id").collect())
    bytes_at = found.get(byte_names[0])
    if any(found.get(name) != (bytes_at or 0) + b for b, name in enumerate(byte_names)):
        bytes_at = None
    if bytes_at is None and UNKNOWN_TOKEN not in found:
        raise ValueError("the vocabulary has neither an unknown token nor all byte rows")
    return vocab, replace(
        cfg,
        mask_id=found[cfg.mask_token],
        eos_id=found.get(EOS_TOKEN),
        unknown_id=found.get(UNKNOWN_TOKEN, max(found.values()) + 256),
        byte_fallback=bytes_at is not None,
        vocab_size=max(vocab.count(), 1) if bytes_at is None else bytes_at - FIRST_CORPUS_ID,
    )


def ensure_token(vocab: DataFrame, token: str) -> DataFrame:
    """Add a special token behind the highest id, unless it is there already."""
    found = F.max(F.when(F.col("token") == token, F.lit(1)))
    added = (
        vocab.agg(found.alias("found"), F.coalesce(F.max("token_id"), F.lit(-1)).alias("last"))
        .where(F.col("found").isNull())
        .select(
            F.lit(token).alias("token"),
            (F.col("last") + 1).cast("int").alias("token_id"),
            F.lit(True).alias("is_special"),
        )
    )
    return vocab.unionByName(added)


def suppressed_ids(vocab: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Ids never chosen as normal text: the mask, and pad, begin and turn marks other than EOS.

    One row per id; at most five rows, whatever the vocabulary.
    """
    spark = vocab.sparkSession
    marks = vocab.where(F.col("token").isin(TURN_START, TURN_END)).select("token_id")
    named = [i for i in (cfg.padding_id, cfg.bos_id) if i is not None]
    others = marks.unionByName(_id_rows(spark, named)) if named else marks
    if cfg.eos_id is not None:
        others = others.where(F.col("token_id") != cfg.eos_id)
    mask = _id_rows(spark, [cfg.mask_id])
    return others.where(F.col("token_id") >= 0).unionByName(mask).distinct()


def id_list(ids: DataFrame) -> DataFrame:
    """The ids as one ascending list."""
    return ids.agg(F.sort_array(F.collect_set("token_id")).alias("token_ids"))
