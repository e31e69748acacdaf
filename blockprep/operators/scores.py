"""Set operators on score tables: (group keys, token_id, logit).

A group is one slot or one context and its rows are the candidates for it.
``token_id`` is unique within a group (score tables come out of an
aggregation, see ``context_counts``), so a group never has more rows than the
vocabulary, whatever the size of the data; windows over a group rely on that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockprep.functions.hashing import uniform

# Shares are compared after rounding to this many digits, so that the outcome
# does not hang on the order in which a sum was taken (is 1/5 above 0.2?).
SHARE_DIGITS = 12

# The context that stands for "any": the overall distribution.
ANY_CONTEXT = -1


def context_counts(pairs: DataFrame) -> DataFrame:
    """(ctx, label, n): how often a label follows a context; summed map-side first."""
    return pairs.groupBy("ctx", "label").agg(F.count(F.lit(1)).alias("n"))


def context_scores(counts: DataFrame) -> DataFrame:
    """Counts as scores (ctx, token_id, logit); softmax turns them into shares."""
    return counts.select(
        "ctx", F.col("label").alias("token_id"), F.log(F.col("n").cast("double")).alias("logit")
    )


def overall_scores(counts: DataFrame) -> DataFrame:
    """Scores of the distribution over all contexts, under ``ANY_CONTEXT``."""
    return (
        counts.groupBy("label")
        .agg(F.sum("n").alias("n"))
        .select(
            F.lit(ANY_CONTEXT).alias("ctx"),
            F.col("label").alias("token_id"),
            F.log(F.col("n").cast("double")).alias("logit"),
        )
    )


def score_with(
    contexts: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Hook for a caller's own model: batches of context rows to score rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return contexts.mapInPandas(run, schema)


def scale(scores: DataFrame, temperature: float) -> DataFrame:
    """Divide by the temperature; zero or less means greedy and changes nothing."""
    if temperature <= 0:
        return scores
    return scores.withColumn("logit", F.col("logit") / F.lit(float(temperature)))


def suppress(scores: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop candidates that may not be chosen; before softmax, so shares are over the rest.

    ``ids`` is the list from ``suppressed_ids``: at most five rows.
    """
    return scores.join(F.broadcast(ids.select("token_id")), "token_id", "left_anti")


def softmax(scores: DataFrame, keys: Sequence[str], logit: str = "logit", prob: str = "prob") -> DataFrame:
    """Add the share of each candidate within its group."""
    group = W.partitionBy(*keys)
    shifted = scores.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(group)))
    return shifted.withColumn(prob, F.col("_e") / F.sum("_e").over(group)).drop("_e")


def argmax(scores: DataFrame, keys: Sequence[str], by: str = "logit", keep: Sequence[str] = ()) -> DataFrame:
    """The best candidate per group, lowest id on ties: (keys, token_id, by, keep)."""
    best = F.max_by(F.struct("token_id", by, *keep), F.struct(by, -F.col("token_id")))
    return scores.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, "_b.token_id", f"_b.{by}", *[f"_b.{c}" for c in keep]
    )


def _by_share(keys: Sequence[str], prob: str):
    return W.partitionBy(*keys).orderBy(F.desc(prob), "token_id")


def _share_before(keys: Sequence[str], prob: str) -> Column:
    frame = _by_share(keys, prob).rowsBetween(W.unboundedPreceding, -1)
    return F.round(F.coalesce(F.sum(prob).over(frame), F.lit(0.0)), SHARE_DIGITS)


def _share_upto(keys: Sequence[str], prob: str) -> Column:
    frame = _by_share(keys, prob).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.round(F.sum(prob).over(frame), SHARE_DIGITS)


def nucleus(probs: DataFrame, keys: Sequence[str], top_p: float, prob: str = "prob") -> DataFrame:
    """Keep the candidates in front of which at most ``top_p`` is used up, and renormalise.

    The first candidate has nothing in front of it and always stays.
    """
    kept = probs.withColumn("_before", _share_before(keys, prob)).where(
        (F.col("_before") <= top_p) | (F.col("_before") == 0.0)
    )
    total = F.sum(prob).over(W.partitionBy(*keys))
    return kept.drop("_before").withColumn(prob, F.col(prob) / total)


def weighted_draw(
    probs: DataFrame, keys: Sequence[str], seed: int, prob: str = "prob", keep: Sequence[str] = ()
) -> DataFrame:
    """Draw one candidate per group with its share as weight: (keys, token_id, prob, keep).

    The draw is a hash of seed and keys: same input, same draw, in any order
    and on any number of partitions.
    """
    u = uniform(seed, *[F.col(k) for k in keys])
    return (
        probs.withColumn("_from", _share_before(keys, prob))
        .withColumn("_to", _share_upto(keys, prob))
        .where((F.col("_from") <= u) & (u < F.col("_to")))
        .select(*keys, "token_id", prob, *keep)
    )


def gather(probs: DataFrame, chosen: DataFrame, keys: Sequence[str], prob: str = "prob") -> DataFrame:
    """The share of the chosen candidate of each group."""
    return chosen.select(*keys, "token_id").join(
        probs.select(*keys, "token_id", prob), [*keys, "token_id"]
    )


def scatter(scores: DataFrame, kept: DataFrame, keys: Sequence[str], prob: str = "prob") -> DataFrame:
    """Shares of the kept candidates on the whole candidate list, zero elsewhere."""
    return (
        scores.select(*keys, "token_id")
        .join(kept.select(*keys, "token_id", prob), [*keys, "token_id"], "left")
        .withColumn(prob, F.coalesce(prob, F.lit(0.0)))
    )


def shift_scores(
    scored: DataFrame, columns: Sequence[str], key: str = "seq_id", pos: str = "pos"
) -> DataFrame:
    """Give position ``i`` the values computed at ``i - 1``; the first keeps its own.

    Sequences are contexts or blocks, so a group is one of bounded length.
    """
    along = W.partitionBy(key).orderBy(pos)
    first = F.row_number().over(along) == 1
    shifted = [
        F.when(first, F.col(c)).otherwise(F.lag(c).over(along)).alias(c) for c in columns
    ]
    return scored.select(*[c for c in scored.columns if c not in columns], *shifted)


def select_confident(
    slots: DataFrame, threshold: float, keys: Sequence[str] = ("seq_id", "sub_block")
) -> DataFrame:
    """Add ``chosen``: masked slots above the threshold, and the best masked slot of each group.

    Needs pos, masked, prob.  A group is one sub-block of one sequence.
    """
    share = F.round("prob", SHARE_DIGITS)
    order = W.partitionBy(*keys).orderBy(F.desc("masked"), share.desc(), "pos")
    best = F.row_number().over(order) == 1
    return slots.withColumn(
        "chosen", F.col("masked") & F.coalesce((share > threshold) | best, best)
    )
