"""The preparation chain, from message rows to views, and scores out of views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockprep.config import PrepConfig
from blockprep.operators.messages import sample_keys
from blockprep.operators.packing import assign_batches, pack
from blockprep.operators.scores import context_counts, context_scores, overall_scores
from blockprep.operators.tokens import tokenize
from blockprep.operators.views import complementary_views, training_pairs
from blockprep.operators.vocabulary import build_vocab, count_tokens
from blockprep.sources.prepared import read_ids, read_vocab, write_ids, write_views
from blockprep.sources.storage import cut_lineage


def corpus_vocab(messages: DataFrame, cfg: PrepConfig) -> DataFrame:
    """The vocabulary of a corpus of message rows."""
    return build_vocab(count_tokens(messages, cfg), cfg)


def freeze_vocab(messages: DataFrame, cfg: PrepConfig, path: str) -> DataFrame:
    """Write the vocabulary once and read it back, so that later steps share one version."""
    corpus_vocab(messages, cfg).coalesce(1).write.mode("overwrite").parquet(path)
    return read_vocab(messages.sparkSession, path)


def batches(
    messages: DataFrame,
    vocab: DataFrame,
    cfg: PrepConfig,
    epoch: int = 0,
    population: DataFrame | None = None,
) -> DataFrame:
    """Tokenized samples in micro-batches.

    ``population`` lists the sample ids; by default they are read off the
    messages, before tokenizing.
    """
    known = sample_keys(messages) if population is None else population
    return assign_batches(tokenize(messages, vocab, cfg), cfg, epoch, known)


def contexts(
    messages: DataFrame,
    vocab: DataFrame,
    cfg: PrepConfig,
    epoch: int = 0,
    population: DataFrame | None = None,
) -> DataFrame:
    """Packed contexts (batch_id, input_ids) of one epoch."""
    return pack(batches(messages, vocab, cfg, epoch, population), cfg)


def views(
    messages: DataFrame,
    vocab: DataFrame,
    cfg: PrepConfig,
    epoch: int = 0,
    population: DataFrame | None = None,
) -> DataFrame:
    """Complementary masked views with labels of one epoch."""
    packed = contexts(messages, vocab, cfg, epoch, population)
    return complementary_views(packed, cfg, epoch)


def pair_counts(messages: DataFrame, vocab: DataFrame, cfg: PrepConfig) -> DataFrame:
    """How often each token follows each masked-view context."""
    return context_counts(training_pairs(views(messages, vocab, cfg)))


def fit_scores(messages: DataFrame, vocab: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Score table for filling: shares by context, and over all contexts.

    The counts are cut off from their lineage, since both parts and the loop
    that uses them start from there.
    """
    counts = cut_lineage(pair_counts(messages, vocab, cfg))
    return context_scores(counts).unionByName(overall_scores(counts))


def store_ids(messages: DataFrame, cfg: PrepConfig, path: str) -> None:
    """Freeze the vocabulary and store every sample's ids once, in buckets of the sample."""
    vocab = freeze_vocab(messages, cfg, f"{path}/vocab")
    buckets = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    write_ids(tokenize(messages, vocab, cfg), f"{path}/ids", buckets)


def stored_batches(spark: SparkSession, cfg: PrepConfig, path: str, epoch: int) -> DataFrame:
    """The micro-batches of an epoch over stored ids: only sample ids are ordered and moved."""
    samples = read_ids(spark, f"{path}/ids")
    return assign_batches(samples, cfg, epoch, samples.select("sample_id"))


def prepare(messages: DataFrame, cfg: PrepConfig, path: str, epoch: int = 0) -> None:
    """Store the views of one epoch under ``path``, one folder per epoch, with the stamp.

    Epoch 0 builds and stores the vocabulary and the samples' ids anew.  Later epochs order the
    stored ids in their own way and leave the other epochs' folders alone.
    """
    spark = messages.sparkSession
    if epoch == 0:
        store_ids(messages, cfg, path)
    packed = pack(stored_batches(spark, cfg, path, epoch), cfg)
    made = complementary_views(packed, cfg, epoch).withColumn("epoch", F.lit(epoch))
    write_views(made, f"{path}/views", cfg)
