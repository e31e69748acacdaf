"""Prompts to answer texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprep.config import PrepConfig
from blockprep.functions.text import strip
from blockprep.operators.filling import fill, sequence_ids
from blockprep.operators.tokens import detokenize, prompt_ids
from blockprep.operators.vocabulary import suppressed_ids


def answers(prompts: DataFrame, vocab: DataFrame, scores: DataFrame, cfg: PrepConfig) -> DataFrame:
    """(sample_id, messages) to (sample_id, answer), all prompts at once.

    ``scores`` is a table (ctx, token_id, logit), see ``fit_scores``.
    """
    coded = prompt_ids(prompts, vocab, cfg).withColumnRenamed("sample_id", "seq_id")
    filled = fill(coded, scores, suppressed_ids(vocab, cfg), cfg)
    texts = detokenize(sequence_ids(filled), vocab, cfg, ["seq_id"])
    return texts.select(F.col("seq_id").alias("sample_id"), strip("text").alias("answer"))
