"""One large JSON array, or objects over many lines, read by many tasks.

A reader of whole files gives a file to one task.  Here a file is cut at every closing brace, in
byte ranges like any text file, and the borders of its records are found afterwards.  What a
piece does to a scanner is a small function: whether its quotes leave it inside a string, and how
it changes the depth, for either state in front of it.  Such functions compose, so the state in
front of each piece comes from running sums: inside a byte range, and over the ranges of a file,
of which there are few.  A record ends where a brace outside strings brings the depth back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockprep.sources.instructions import INSTRUCTION_SCHEMA

_RANGE = ["file", "start"]


def _depth(parts: Column, inside: int) -> Column:
    """Opening less closing brackets in the parts between quotes that lie outside strings."""
    outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == inside), " ")
    count = lambda marks: F.length(F.regexp_replace(outside, f"[^{marks}]", ""))
    return count(r"\[{") - count(r"\]}")


def _pieces(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, start, at, piece, flips, d0, d1): pieces between closing braces, and what they do.

    ``flips`` is 1 if a piece leaves a string open or closes one; ``d0`` and ``d1`` are its depth
    if it starts outside or inside a string, its closing brace included.
    """
    read = spark.read.option("lineSep", "}").text(list(paths))
    rows = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("piece"),
    )
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    parts = F.split(plain, '"', -1)
    flips = (F.size("parts") - 1) % 2
    return rows.withColumn("parts", parts).select(
        "file",
        "start",
        "at",
        "piece",
        flips.alias("flips"),
        (_depth(F.col("parts"), 0) - (1 - flips)).alias("d0"),
        (_depth(F.col("parts"), 1) - flips).alias("d1"),
    )


def json_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, record, text): the objects of each file, as texts."""
    pieces = _pieces(spark, [paths] if isinstance(paths, str) else paths)
    inside = W.partitionBy(*_RANGE).orderBy("at")
    upto, before = inside.rowsBetween(W.unboundedPreceding, W.currentRow), inside.rowsBetween(W.unboundedPreceding, -1)
    # The state in front of a piece, if its range starts outside (0) or inside (1) a string.
    flipped = F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2
    local = pieces.withColumn("odd", flipped)
    for s in (0, 1):
        own = F.when((F.col("odd") + s) % 2 == 0, F.col("d0")).otherwise(F.col("d1"))
        local = local.withColumn(f"depth{s}", F.sum(own).over(upto))
    ranges = local.groupBy(*_RANGE).agg(
        (F.sum("flips") % 2).alias("flips"), F.max_by("depth0", "at").alias("depth0"), F.max_by("depth1", "at").alias("depth1"),
        F.regexp_extract(F.min_by("piece", "at"), r"(?s)^﻿?\s*(\[?)", 1).alias("first"),
    )
    # Few rows: one per byte range of a file.
    along = W.partitionBy("file").orderBy("start")
    past = along.rowsBetween(W.unboundedPreceding, -1)
    entered = ranges.withColumn("state", F.coalesce(F.sum("flips").over(past), F.lit(0)) % 2)
    own = F.when(F.col("state") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    entered = entered.withColumn("front", F.coalesce(F.sum(own).over(past), F.lit(0)))
    base = (F.first("first").over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) == "[").cast("int")
    entered = entered.select(*_RANGE, "state", "front", base.alias("base"))
    known = local.join(F.broadcast(entered), _RANGE)
    depth = F.col("front") + F.when(F.col("state") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    closed = (F.col("odd") + F.col("state") + F.col("flips")) % 2 == 0
    known = known.withColumn("ends", (closed & (depth == F.col("base"))).cast("long"))
    # Records are numbered inside a range and shifted by the records that end in earlier ranges.
    counted = known.withColumn("number", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    totals = known.groupBy(*_RANGE).agg(F.sum("ends").alias("n"))
    shifts = totals.select(*_RANGE, F.coalesce(F.sum("n").over(past), F.lit(0)).alias("shift"))
    numbered = counted.join(F.broadcast(shifts), _RANGE).withColumn("record", F.col("number") + F.col("shift"))
    whole = numbered.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("start", "at", "piece"))).alias("p"), F.max("ends").alias("whole")
    )
    text = F.concat(F.array_join(F.transform("p", lambda p: p["piece"]), "}"), F.when(F.col("whole") == 1, "}").otherwise(""))
    text = F.regexp_replace(text, r"(?s)^﻿?[\s,\[\]]*", "")
    return whole.select("file", "record", text.alias("text")).where("text <> ''")


def read_json_array(
    spark: SparkSession, paths: str | Sequence[str], keys: Sequence[T.StructField] = ()
) -> DataFrame:
    """Instruction rows of files that hold one array, or objects one after the other, over many lines.

    The same rows as a whole-file read of the same files; what is no object that can be read is
    in ``_corrupt_record``, with anything in front of it that is none.
    """
    schema = T.StructType([*keys, *INSTRUCTION_SCHEMA.fields])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = json_records(spark, paths).select(F.from_json("text", schema, options).alias("r"))
    return parsed.select("r.*")
