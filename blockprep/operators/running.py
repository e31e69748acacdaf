"""Ordered running totals that no single key can push into one task.

A window over ``partitionBy(key)`` sorts a whole group in one task.  Where a
key may hold a large share of all rows, the group is cut into fixed stretches
of its order column first: totals run inside each stretch, the far smaller
table of stretch totals is summed up in front of every stretch, and the two
are joined on (key, stretch), which is how the big side is already placed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockprep.sources.storage import cut_lineage

# Order values per stretch: one task holds at most this many rows of a key.
STRETCH = 65_536

# Leading hex digits of the hash that name a bucket of the seeded order.
BUCKET_DIGITS = 4
MAX_BUCKETS = 16**BUCKET_DIGITS


def _stretched(df: DataFrame, order: str, stretch: int) -> DataFrame:
    return df.withColumn("_stretch", F.floor(F.col(order) / F.lit(stretch)))


def _inside(cut: Sequence[str], order: str) -> WindowSpec:
    return W.partitionBy(*cut).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)


def _before(keys: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: Mapping[str, Column],
    stretch: int = STRETCH,
) -> DataFrame:
    """Add inclusive running sums, one column per entry of ``totals``.

    ``order`` is a counter that is unique within a key (a turn number): the
    table of stretch totals has one row per 65,536 values of it.
    """
    names = list(totals)
    base = _stretched(df, order, stretch)
    cut = [*keys, "_stretch"]
    local = base.select("*", *[F.sum(totals[n]).over(_inside(cut, order)).alias(n) for n in names])
    before = _before(keys)
    carried = (
        base.groupBy(*cut)
        .agg(*[F.sum(totals[n]).alias(n) for n in names])
        .select(*cut, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in names])
    )
    kept = [c for c in df.columns if c not in names]
    return local.join(carried, cut).select(
        *kept, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in names]
    )


def running_counts_with_reset(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: Mapping[str, Column],
    name: str,
    counted: Column,
    reset: Column,
    stretch: int = STRETCH,
) -> DataFrame:
    """Running sums as above, plus ``name``: counted rows since the last reset row.

    Reset rows are not counted themselves.  All columns come out of one pass:
    inside a stretch the count at the last reset is subtracted; in front of
    the first reset the rows since a reset in an earlier stretch are added.
    """
    names = list(totals)
    cut = [*keys, "_stretch"]
    inside = _inside(cut, order)
    local = (
        _stretched(df, order, stretch)
        .select(
            "*",
            F.sum(counted.cast("int")).over(inside).alias("_count"),
            *[F.sum(totals[n]).over(inside).alias(n) for n in names],
        )
        .withColumn("_at_reset", F.max(F.when(reset, F.col("_count"))).over(inside))
    )
    before = _before(keys)
    # Running sums never fall, so their maximum is the total of the stretch.
    ends = local.groupBy(*cut).agg(*[F.max(c).alias(c) for c in ("_count", "_at_reset", *names)])
    carried = (
        ends.withColumn("_ahead", F.coalesce(F.sum("_count").over(before), F.lit(0)))
        .withColumn("_reset_at", F.max(F.col("_ahead") + F.col("_at_reset")).over(before))
        .select(
            *cut,
            (F.col("_ahead") - F.coalesce("_reset_at", F.lit(0))).alias("_open"),
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in names],
        )
    )
    since = F.coalesce(F.col("_count") - F.col("_at_reset"), F.col("_count") + F.col("_open"))
    return local.join(carried, cut).select(
        *df.columns,
        *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in names],
        since.alias(name),
    )


def dense_order(
    df: DataFrame, rank_hash: Column, tie: str, name: str, within: Sequence[str] = ()
) -> DataFrame:
    """Number all rows 0, 1, ... in the order of (hash, tie), without one big sort.

    Rows are cut by the leading digits of the hash, which spreads any key set
    evenly; each bucket is numbered on its own and shifted by the rows in the
    buckets before it.  The bucket table has at most ``MAX_BUCKETS`` rows per
    value of ``within``, whatever the input size.  The input is read twice,
    so it should be narrow and cheap: ids, not what hangs on them.
    """
    cut = [*within, "_bucket"]
    base = df.withColumn("_hash", rank_hash).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )
    inside = W.partitionBy(*cut).orderBy("_hash", tie)
    local = base.withColumn("_local", F.row_number().over(inside) - 1)

    # A fixed-size table: the unpartitioned window sees MAX_BUCKETS rows at most.
    before = W.partitionBy(*(within or [F.lit(0)])).orderBy("_bucket")
    shifts = (
        base.groupBy(*cut)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *cut,
            F.coalesce(
                F.sum("_rows").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ).alias("_shift"),
        )
    )
    side = shifts if within else F.broadcast(shifts)
    return local.join(side, cut).select(
        *df.columns, (F.col("_shift") + F.col("_local")).alias(name)
    )


def sorted_numbers(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number all rows 0, 1, ... in a given order, in as many tasks as the shuffle has partitions.

    Rows are sorted by ranges and numbered inside each; a table of one row per range says how
    many are in front of it.  The order must leave no ties.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit(2**33 - 1)).alias("_local"))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    shifts = shifts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    return placed.join(F.broadcast(shifts), "_part").select(*df.columns, (F.col("_shift") + F.col("_local")).alias(name))
