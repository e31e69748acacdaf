"""A global shuffle into shards: scatter into buckets, then shuffle each bucket.

Pass one sends every row to one of many buckets by a seeded hash of its key and text, so
that buckets are alike in size and fit in memory.  Pass two puts each bucket into a
canonical order and runs a Fisher-Yates shuffle over it, seeded by the bucket's number.
Buckets laid end to end are a uniformly shuffled table; shard s is its s-th cut of equal
row count (the law "rows": counts differ by one at most), so a row's shard and slot follow
from its bucket's offset and its place in the bucket.

Rows without text have size 1.  Rows with equal keys but other texts scatter like any
others; rows equal in key and text share a bucket.  An empty table gives no rows.  Fewer
rows than shards leave the last shards empty.  Columns named like a new one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockprep.llm.common import count_and_bytes, parts_of

#: Bytes of text in a bucket.
BUCKET_BYTES = 16 << 20


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of n places: swap each place with one not yet passed."""
    places = np.arange(n)
    draws = np.random.default_rng(seed).integers(0, np.arange(n, 0, -1)) if n else places
    order = places.tolist()
    for i, step in enumerate(draws.tolist()):
        j = i + step
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shard_documents(
    df: DataFrame,
    shards: int = 16,
    seed: int = 42,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows with their ``shard`` and, gapless from 0 in each shard, their ``slot``."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows, size = count_and_bytes(df, text)
    buckets = parts_of(df.sparkSession, size, bucket_bytes)
    names = [c for c in df.columns if c.lower() not in ("shard", "slot", "_bucket", "_hash", "_place")]
    placed = df.select(*[F.col(f"`{c}`") for c in names]).withColumn(
        "_hash", F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`"))
    )
    placed = placed.withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(buckets)).cast("int"))
    schema = T.StructType([f for f in placed.schema.fields if f.name != "_hash"]).add("_place", "long")

    def shuffle(number: tuple, bucket: pa.Table) -> pa.Table:
        # Arrival order depends on the cluster; the hash does not.
        at = pc.sort_indices(bucket, sort_keys=[("_hash", "ascending")])
        order = fisher_yates(bucket.num_rows, [seed, number[0].as_py()])
        mixed = bucket.drop_columns(["_hash"]).take(at.take(pa.array(order)))
        return mixed.append_column("_place", pa.array(np.arange(bucket.num_rows)))

    mixed = placed.groupBy("_bucket").applyInArrow(shuffle, schema)
    counts = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    # One row per bucket: its number is known, and small beside one bucket's rows.
    offsets = F.broadcast(offsets) if buckets <= 1_000_000 else offsets
    return _cut(mixed.join(offsets, "_bucket"), rows, shards).select(*names, "shard", "slot")


def _cut(df: DataFrame, rows: int, shards: int) -> DataFrame:
    """Shard and slot of each global place; the first shards get the odd rows."""
    low, odd = divmod(rows, shards)
    place = F.col("_offset") + F.col("_place")
    long_part = F.lit(odd * (low + 1))
    shard = F.when(place < long_part, F.floor(place / F.lit(low + 1))).otherwise(
        F.lit(odd) + F.floor((place - long_part) / F.lit(max(low, 1)))
    )
    start = F.col("shard") * low + F.least(F.col("shard"), F.lit(odd))
    return df.withColumn("shard", shard.cast("int")).withColumn("slot", (place - start).cast("long"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard into its folder ``shard=N``, in slot order within the files."""
    parts = parts_of(sharded.sparkSession, 0, 1)
    placed = sharded.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot")
    placed.write.mode("overwrite").partitionBy("shard").parquet(path)
