"""Masked views with labels, and what is derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockprep.config import IGNORE_LABEL, PrepConfig
from blockprep.functions.hashing import coin_array


def mask_coins(contexts: DataFrame, cfg: PrepConfig, epoch: int = 0) -> DataFrame:
    """Add ``coins``: a fair 0/1 per position, fixed by seed, epoch, batch and position."""
    coins = coin_array(F.size("input_ids"), cfg.seed, epoch, F.col("batch_id"))
    return contexts.withColumn("coins", coins)


def complementary_views(contexts: DataFrame, cfg: PrepConfig, epoch: int = 0) -> DataFrame:
    """Two rows per context: (batch_id, view, input_ids, labels).

    View 0 masks the valid positions with coin 1, view 1 the others; a label
    stands at every masked valid position and the ignore value elsewhere.
    Both views come from one pass (an ``explode``), and per position only
    array expressions run.
    """
    views = mask_coins(contexts, cfg, epoch).select(
        "batch_id", "input_ids", "coins", F.explode(F.array(F.lit(0), F.lit(1))).alias("view")
    )
    wanted = F.lit(1) - F.col("view")

    def hidden(token, coin):
        return (token != cfg.mask_id) & (coin == wanted)

    return views.select(
        "batch_id",
        "view",
        F.zip_with(
            "input_ids", "coins", lambda t, c: F.when(hidden(t, c), F.lit(cfg.mask_id)).otherwise(t)
        ).alias("input_ids"),
        F.zip_with(
            "input_ids", "coins", lambda t, c: F.when(hidden(t, c), t).otherwise(F.lit(IGNORE_LABEL))
        ).alias("labels"),
    )


def stacked_labels(cfg: PrepConfig) -> Column:
    """Of a row with coins, the labels of both views as [views][sequence]."""

    def labels(wanted: int) -> Column:
        return F.zip_with(
            "input_ids",
            "coins",
            lambda t, c: F.when((t != cfg.mask_id) & (c == wanted), t).otherwise(F.lit(IGNORE_LABEL)),
        )

    return F.array(labels(1), labels(0))


def view_positions(views: DataFrame, keys: Sequence[str] = ("batch_id", "view")) -> DataFrame:
    """Long form: (batch_id, view, pos, input_id, label)."""
    return (
        views.select(*keys, F.col("input_ids").alias("input_id"), F.col("labels").alias("label"))
        .select(*keys, F.posexplode(F.arrays_zip("input_id", "label")).alias("pos", "p"))
        .select(*keys, "pos", "p.input_id", "p.label")
    )


def flatten_views(stacked: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """[views][sequence] arrays to one row per view."""
    return stacked.select(*keys, F.posexplode(column).alias("view", column))


def training_pairs(views: DataFrame) -> DataFrame:
    """(batch_id, view, pos, ctx, label): the input before each labelled position.

    Position 0 has nothing before it and so no pair.  Both arrays are lined up
    first, so that no exploded row carries a whole array along.
    """
    before = F.concat(
        F.array(F.lit(None).cast("int")),
        F.slice("input_ids", F.lit(1), F.greatest(F.size("input_ids") - 1, F.lit(0))),
    )
    return (
        views.select("batch_id", "view", before.alias("ctx"), F.col("labels").alias("label"))
        .select("batch_id", "view", F.posexplode(F.arrays_zip("ctx", "label")).alias("pos", "p"))
        .where((F.col("pos") >= 1) & (F.col("p.label") != IGNORE_LABEL))
        .select("batch_id", "view", "pos", "p.ctx", "p.label")
    )


def batch_profile(views: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Per view: positions, masked-and-labelled, visible, and padding counts.

    A view is one row, so its counts need no grouping.
    """
    labelled = F.size(F.filter("labels", lambda y: y != IGNORE_LABEL))
    masked = F.size(F.filter("input_ids", lambda t: t == cfg.mask_id))
    return views.select(
        "batch_id",
        "view",
        F.size("input_ids").alias("positions"),
        labelled.alias("labelled"),
        (F.size("input_ids") - masked).alias("visible"),
        (masked - labelled).alias("padding"),
    )


def attach_visibility(views: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Add ``visible_upto``: for each query position, the first key it does not see.

    The bound follows from the position alone, so no pairs are built and
    nothing is joined: the border of each block, once per position in it.
    """
    length, block = F.size("input_ids"), F.lit(cfg.block_size)
    whole = F.floor(length / block).cast("int") * block
    borders = F.concat(
        F.when(whole > 0, F.sequence(block, whole, block)).otherwise(F.array().cast("array<int>")),
        F.when(whole < length, F.array(length)).otherwise(F.array().cast("array<int>")),
    )
    per_position = F.flatten(F.transform(borders, lambda b: F.array_repeat(b, cfg.block_size)))
    return views.withColumn("visible_upto", F.slice(per_position, F.lit(1), length))
