"""Joins on keys of which a few are very frequent.

A sketch of frequent items is summed up over all rows: it takes a bounded number of counters per
task and merges, so that finding the frequent keys moves little and their number is bounded.
Their rows of the other table are broadcast and met where the rows are; all other rows are
joined by shuffle, where no key has many.  The two parts make one result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent keys that are sought, and counters of the sketch.
HEAVY_KEYS, COUNTERS = 1024, 16_384


def heavy_keys(df: DataFrame, key: str, most: int = HEAVY_KEYS) -> DataFrame:
    """(key): at most ``most`` of the most frequent keys, found by a mergeable sketch.

    Counts of the sketch are estimates; which keys it names decides where rows are joined, not
    what comes out.
    """
    known = df.where(F.col(key).isNotNull())
    sketch = known.agg(F.expr(f"approx_top_k(`{key}`, {most}, {max(COUNTERS, 2 * most)})").alias("k"))
    return sketch.select(F.explode("k").alias("k")).select(F.col("k.item").alias(key))


def heavy_join(df: DataFrame, table: DataFrame, key: str, most: int = HEAVY_KEYS) -> DataFrame:
    """``df`` left joined with ``table`` on ``key``, which is unique in ``table``.

    Rows without a key keep NULLs and are not moved.
    """
    named = F.broadcast(heavy_keys(df, key, most))
    frequent = table.join(named, key, "left_semi")
    here = df.join(named.withColumn("_heavy", F.lit(True)), key, "left")
    near = F.col("_heavy") | F.col(key).isNull()
    met = here.where(F.coalesce(near, F.lit(False))).drop("_heavy").join(F.broadcast(frequent), key, "left")
    rest = here.where(~F.coalesce(near, F.lit(False))).drop("_heavy").join(table.hint("merge"), key, "left")
    return met.unionByName(rest)
