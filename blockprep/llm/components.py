"""Connected components by alternating stars, each round a few group-bys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprep.llm.common import release
from blockprep.sources.storage import cut_lineage


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def stars(edges: DataFrame) -> DataFrame:
    """From links (u, v) to one row (u, v) per linked node u, v the least node it reaches.

    The least node of a component has no row.  Large stars hang each greater neighbour of a
    node on the least one around it, small stars hang the smaller ones together; both sum
    up per node before the shuffle, so that a node with many links costs no more than others.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = cut_lineage(edges.distinct())
    before = _summary(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        del both, least, large, smallest, small
        release(edges.sparkSession)
        after = _summary(edges)
        if after == before:
            break
        before = after
    return edges
