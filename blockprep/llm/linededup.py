"""Line dedup: later copies of repeated runs of lines are deleted.

A line goes if it stands in a run of lines of at least ``min_words`` words that also stands in
an earlier place.  Such a run is found by winnowing: a window is a shortest run of
``min_words`` words or more from a line on, or up to a line, and of each window the last line
with the least hash is its fingerprint.  Equal windows have equal fingerprints, and
neighbouring windows mostly share one.  Places of fingerprints are counted; only windows
around those in more than one place are met with each other, by a hash of the window as a
whole, and those equal to an earlier window are matches.  The windows around a fingerprint
reach as far to both sides as lines go on being equal to those of *any* earlier place, and
windows up to a line catch the end of a run that is too short for a window of its own, so
that no part of a repeated run stays.  Overlapping matches are joined and deleted.

Order is that of (doc_id, text hash, line); documents without an id come last.  Lines are cut
at newlines and compared without blanks at their ends; a line counts as one word at least.
NULL and empty texts, and those with too few words, lose nothing.  Rows equal in id and text
are one document: they lose the same lines.  A line repeated within a document is treated
like one repeated elsewhere, also if the two runs overlap.  An empty table stays empty.  A
text of any length is worked on as rows of lines; only hashes and word counts of its lines
are held together.  Columns named like a new one are replaced.

Everything is DataFrame code.  Fingerprints and windows that stand for many rows (the 1,024
most frequent of each, so that any other has at most a 1,024th of all rows) are met by a
broadcast of their keys, and their rows are dealt over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockprep.sources.storage import cut_lineage

#: A repeated run of so many words is found for certain.
MIN_WORDS = 50
#: Keys that may be broadcast.
HOT = 1024


def _identity(doc_id: str, text: str) -> Column:
    """What orders documents and tells them apart."""
    own = F.col(f"`{doc_id}`")
    return F.struct(
        own.isNull().alias("absent"),
        F.coalesce(own, F.lit(0)).alias("id"),
        F.xxhash64(F.col(f"`{text}`")).alias("hash"),
    )


def document_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc`` and the hashes ``h`` and word counts ``w`` of its lines."""
    lines = F.transform(F.split(F.col(f"`{text}`"), "\n"), lambda x: F.trim(F.regexp_replace(x, "\r$", "")))
    return (
        docs.where(F.col(f"`{text}`").isNotNull())
        .select(_identity(doc_id, text).alias("doc"), lines.alias("lines"))
        .select(
            "doc",
            F.transform("lines", lambda x: F.xxhash64(x)).alias("h"),
            F.transform("lines", lambda x: F.greatest(F.regexp_count(x, F.lit("\\S+")), F.lit(1))).alias("w"),
        )
        .groupBy("doc")
        .agg(F.first("h").alias("h"), F.first("w").alias("w"))
    )


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Windows (doc, low, high) with their fingerprint (least, at line ``pos``) and the hash of the whole."""
    rows = lines.select("doc", F.posexplode(F.arrays_zip("h", "w"))).select(
        "doc", F.col("pos").alias("i"), F.col("col.h").alias("h"), F.col("col.w").cast("long").alias("w")
    )
    upto = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("w").over(upto)).withColumn("start", F.col("end") - F.col("w"))
    # From a line on: lines that begin before min_words words have passed; up to a line: the reverse.
    frames = {
        "onward": Window.partitionBy("doc").orderBy("start").rangeBetween(0, min_words - 1),
        "upward": Window.partitionBy("doc").orderBy("end").rangeBetween(1 - min_words, 0),
    }
    found = [
        F.struct(
            F.min("i").over(run).alias("low"),
            F.max("i").over(run).alias("high"),
            F.sum("w").over(run).alias("words"),
            F.min(F.struct(F.col("h"), (-F.col("i")).alias("i"))).over(run).alias("least"),
            F.xxhash64(F.collect_list("h").over(run)).alias("whole"),
        ).alias(name)
        for name, run in frames.items()
    ]
    # A window up to a line that is too short without it is a window from a line on, too.
    known = (F.col("onward.words") >= min_words, F.col("upward.words") - F.col("w") >= min_words)
    return (
        rows.select("doc", "w", *found)
        .select(
            "doc",
            F.explode(F.filter(F.array(F.when(known[0], F.col("onward")), F.when(known[1], F.col("upward"))), F.isnotnull)).alias("x"),
        )
        .select(
            "doc",
            "x.low",
            "x.high",
            (-F.col("x.least.i")).alias("pos"),
            F.col("x.least.h").alias("least"),
            "x.whole",
        )
    )


def _met(rows: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with the ``value`` that ``found`` (one row per key, ``n`` rows strong) has for their keys.

    Rows of the ``HOT`` keys with the largest ``n`` meet them by broadcast; in the shuffle of
    the rest they are dealt by document, and what they might meet there is not used.
    """
    hot = found.orderBy(F.desc("n"), *keys).limit(HOT).select(*keys, F.col(value).alias("hot"))
    first, *others = keys
    at = F.when(F.col("hot").isNull(), F.col(first)).otherwise(F.xxhash64("doc", "low"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("at", at)
    rest = found.select(F.col(first).alias("at"), *others, F.col(value).alias("rest"))
    joined = dealt.join(rest, ["at", *others], "left").withColumn(value, F.coalesce("hot", "rest"))
    return joined.where(F.col(value).isNotNull()).select(*rows.columns, value)


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs (doc, low, high) of lines that also stand in an earlier place."""
    found = windows(lines, min_words)
    places = found.groupBy("doc", "pos", "least").agg(F.lit(1).alias("one"))
    prints = places.groupBy("least").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    near = cut_lineage(_met(found, prints.withColumn("places", F.col("n")), ["least"], "places").drop("places"))
    firsts = (
        near.groupBy("least", "whole")
        .agg(F.min(F.struct("doc", "low")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    matches = _met(near, firsts, ["least", "whole"], "first")
    matches = matches.where(F.struct("doc", "low") > F.col("first")).select("doc", "low", "high")
    before = Window.partitionBy("doc").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("doc").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce((F.col("low") > F.max("high").over(before) + 1).cast("int"), F.lit(1))
    return (
        matches.withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(so_far))
        .groupBy("doc", "run")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .drop("run")
    )


def dedup_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All rows, their text without later copies; adds ``n_lines`` and ``n_removed``."""
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "_doc", "_runs")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    runs = repeated_runs(document_lines(docs, doc_id, text), min_words)
    runs = runs.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("_runs"))
    joined = docs.withColumn("_doc", _identity(doc_id, text))
    joined = joined.join(runs.withColumnRenamed("doc", "_doc"), "_doc", "left")
    lines = F.split(F.col(f"`{text}`"), "\n")
    left = F.filter(lines, lambda x, i: ~F.exists("_runs", lambda r: i.between(r["low"], r["high"])))
    whole = F.col("_runs").isNull()
    removed = F.aggregate("_runs", F.lit(0).cast("long"), lambda s, r: s + r["high"] - r["low"] + 1)
    columns = [
        F.when(whole, F.col(f"`{c}`")).otherwise(F.array_join(left, "\n")).alias(c)
        if c.lower() == text.lower()
        else F.col(f"`{c}`")
        for c in kept
    ]
    return joined.select(
        *columns,
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).alias("n_removed"),
    )
