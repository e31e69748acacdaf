"""Samples to micro-batches, micro-batches to fixed contexts, contexts to steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockprep.config import PrepConfig
from blockprep.functions.arrays import fit_context, pad_block, truncate
from blockprep.functions.hashing import hash_key, permuted
from blockprep.operators.running import dense_order


def assign_batches(
    samples: DataFrame, cfg: PrepConfig, epoch: int = 0, population: DataFrame | None = None
) -> DataFrame:
    """Shuffle all samples by seed and epoch; add (batch_id, slot).

    ``sample_id`` is unique; batches hold ``cfg.micro_batch`` samples, the
    last one maybe fewer.  Only the ids are numbered, and joined back on
    ``sample_id``, by which tokenized samples are already placed: the token
    lists themselves do not move.  ``population`` may list the same ids from a
    cheaper source than ``samples``, such as the table these were made from.
    """
    rank = hash_key(cfg.seed, epoch, F.col("sample_id"))
    ids = (samples if population is None else population).select("sample_id")
    numbered = dense_order(ids, rank, "sample_id", "_index").select(
        "sample_id",
        F.floor(F.col("_index") / F.lit(cfg.micro_batch)).alias("batch_id"),
        F.pmod("_index", F.lit(cfg.micro_batch)).cast("int").alias("slot"),
    )
    return numbered if samples.columns == ["sample_id"] else samples.join(numbered, "sample_id")


def pad_samples(batches: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Cut each sample to the context and fill it to a block border."""
    return batches.withColumn(
        "input_ids",
        pad_block(truncate("input_ids", cfg.context_length), cfg.block_size, cfg.mask_id),
    )


def pack_offsets(batches: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Where each padded sample starts inside its batch: (sample_id, batch_id, slot, padded_len, offset)."""
    before = W.partitionBy("batch_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return pad_samples(batches, cfg).select(
        "sample_id",
        "batch_id",
        "slot",
        F.size("input_ids").alias("padded_len"),
        F.coalesce(F.sum(F.size("input_ids")).over(before), F.lit(0)).alias("offset"),
    )


def pack(batches: DataFrame, cfg: PrepConfig) -> DataFrame:
    """One context per batch: (batch_id, input_ids), samples joined in slot order.

    A batch holds at most ``cfg.micro_batch`` samples of at most one context
    each.  Batches of one sample need no grouping, and so no shuffle.
    """
    padded = pad_samples(batches, cfg)
    if cfg.micro_batch == 1:
        joined = padded.select("batch_id", "input_ids")
    else:
        joined = (
            padded.groupBy("batch_id")
            .agg(F.array_sort(F.collect_list(F.struct("slot", "input_ids"))).alias("s"))
            .select(
                "batch_id", F.flatten(F.transform("s", lambda s: s["input_ids"])).alias("input_ids")
            )
        )
    if not cfg.pad_to_context:
        return joined
    return joined.withColumn("input_ids", fit_context("input_ids", cfg.context_length, cfg.mask_id))


def step_plan(
    samples: DataFrame,
    cfg: PrepConfig,
    max_steps: int,
    accumulation: int,
    keys: Sequence[str] = ("sample_id",),
    index: str | None = None,
) -> DataFrame:
    """Which sample is read in which optimizer step: (step, micro, epoch, slot, sample_id).

    Epochs follow each other, each in its own order, until ``max_steps *
    accumulation`` micro-batches are used.  The first of ``keys`` names a sample.
    Samples are numbered once (``index`` names dense numbers from 0 that they have
    already); an epoch's order is a seeded bijection of the numbers, so that step,
    micro-batch and slot are a projection, and what lies behind the last step is
    left out before anything else happens to it.
    """
    wanted = max_steps * accumulation
    total = samples.count()
    per_epoch = max(-(-total // cfg.micro_batch), 1)
    epochs = max(-(-wanted // per_epoch), 1) if total and wanted > 0 else 1
    if index is None:
        named = hash_key(cfg.seed, "index", F.col(keys[0]))
        numbered = dense_order(samples.select(*keys), named, keys[0], "_number")
    else:
        numbered = samples.select(*keys, F.col(index).alias("_number"))
    every = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    placed = numbered.withColumn("epoch", every).withColumn(
        "_index", permuted(F.col("_number"), max(total, 1), cfg.seed, F.col("epoch"))
    )
    micro = F.col("epoch") * F.lit(per_epoch) + F.floor(F.col("_index") / F.lit(cfg.micro_batch))
    return placed.withColumn("micro", micro.cast("long")).where(F.col("micro") < wanted).select(
        F.floor(F.col("micro") / F.lit(accumulation)).alias("step"),
        "micro",
        "epoch",
        F.pmod("_index", F.lit(cfg.micro_batch)).cast("int").alias("slot"),
        *keys,
    )
