"""Alias tables: a weighted draw from any number of candidates with two numbers each.

A group of n candidates has n cells of the same size.  Each cell belongs to one candidate up to
``accept`` and to another, its alias, beyond, so that the parts of all cells add up to the
shares.  A draw picks a cell and compares one number; nothing is searched.

The tables are made by running sums instead of work lists.  Candidates below the mean share
(light) lack something of a cell, those above it (heavy) have something over.  With both laid out
in the order of their ids, a light cell is filled up by the heavy candidate whose summed surplus
first reaches the lack in front of it; a heavy candidate that gives more than it has over is
filled up by the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockprep.operators.scores import SHARE_DIGITS
from blockprep.sources.storage import deal, finer_parts


def _rounded(value: Column) -> Column:
    return F.round(value, SHARE_DIGITS)


def alias_tables(probs: DataFrame, keys: Sequence[str], prob: str = "prob") -> DataFrame:
    """(keys, size, cell, token_id, prob, accept, alias_id, alias_prob): one row per candidate."""
    group, by_id = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("token_id")
    upto = by_id.rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.count(F.lit(1)).over(group)
    # Each window below sorts what its task has; so tasks get few groups.
    dealt = deal(probs.select(*keys, "token_id", F.col(prob).alias("prob")), keys, finer_parts(probs.sparkSession))
    laid = (
        dealt.withColumn("size", size)
        .withColumn("cell", F.row_number().over(by_id) - 1)
        .withColumn("_fill", _rounded(F.col("prob") * F.col("size")))
        .withColumn("_heavy", F.col("_fill") > 1)
        .withColumn("_lack", _rounded(F.coalesce(F.sum(F.when(~F.col("_heavy"), 1 - F.col("_fill"))).over(upto), F.lit(0.0))))
        .withColumn("_over", _rounded(F.coalesce(F.sum(F.when(F.col("_heavy"), F.col("_fill") - 1)).over(upto), F.lit(0.0))))
    )
    light_from = _rounded(F.col("_lack") - (1 - F.col("_fill")))
    this = F.when(F.col("_heavy"), F.struct("token_id", "prob"))

    def behind(place: Column) -> WindowSpec:
        """Rows that come later by place, light before heavy, nearest last."""
        order = W.partitionBy(*keys).orderBy(place.desc(), F.desc("_heavy"), F.desc("token_id"))
        return order.rowsBetween(W.unboundedPreceding, -1)

    filler = F.last(this, ignorenulls=True).over(behind(F.when(F.col("_heavy"), F.col("_over")).otherwise(light_from)))
    debt = F.last(F.when(~F.col("_heavy"), F.col("_lack")), ignorenulls=True).over(
        behind(F.when(F.col("_heavy"), F.col("_over")).otherwise(F.col("_lack")))
    )
    next_heavy = F.last(this, ignorenulls=True).over(
        W.partitionBy(*keys).orderBy(F.desc("token_id")).rowsBetween(W.unboundedPreceding, -1)
    )
    last_heavy = F.max(this).over(group)
    own = F.struct("token_id", "prob")
    gives = F.col("_heavy") & F.col("_next").isNotNull() & F.col("_debt").isNotNull()
    accept = (
        F.when(gives, _rounded(1 - (F.col("_debt") - F.col("_over"))))
        .when(F.col("_heavy"), F.lit(1.0))
        .otherwise(F.col("_fill"))
    )
    alias = F.when(F.col("_heavy"), F.col("_next")).otherwise(F.coalesce("_filler", "_last"))
    return (
        laid.withColumns({"_filler": filler, "_debt": debt, "_next": next_heavy, "_last": last_heavy})
        .withColumn("_alias", F.coalesce(alias, own))
        .select(
            *keys,
            "size",
            "cell",
            "token_id",
            "prob",
            accept.alias("accept"),
            F.col("_alias.token_id").alias("alias_id"),
            F.col("_alias.prob").alias("alias_prob"),
        )
    )
