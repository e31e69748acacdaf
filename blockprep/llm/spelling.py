"""Spelling variants by sorted rotations: words that differ by one character, and their forms.

A word with an end mark has a rotation for each place.  Two words of one length that differ by
a replaced character have, from behind that character on, rotations that differ in their last
character only; a word that lacks one of another's characters has a whole rotation that is the
other's without its last character.  So each rotation is keyed by all but its last character
(long members), and each whole rotation by itself (the whole member): sorted by that key, the
words near each other stand in one prefix range.  A range has at most one whole member and one
long member per character of the alphabet, as key and character make the word, so that it is
bounded whatever the number of words.

Ranges are scanned with their members in the order of frequency.  Each member takes from its
range the number of words near to it and the best of them; pairs are never made.  A lost
character within a run of equal ones gives the same word for each of them, and counts at the
run's first place only.

NULL and empty texts hold no words, an empty table gives no rows, and words that hold the end
mark (U+0000) or are NULL take no part.  Words that repeat in a word table count with the sum of
their numbers.  Long words have a row per place, long texts none beyond their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockprep.sources.storage import cut_lineage

#: The mark behind a word; no word holds it.
END = "\u0000"

# Fixed value: letters that make up a word.
LETTERS = "[A-Za-zÀ-ÿ]+"


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, run): every maximal run of letters, A-Z in lower case."""
    found = F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("run")).withColumn("run", lower)


def with_slips(found: DataFrame, every: int) -> DataFrame:
    """Delete a character from about one in ``every`` runs, chosen by a checksum of id and run.

    A row without an id keeps its runs.
    """
    sum_ = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "run"))
    at = F.pmod(F.col("_sum"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    slips = F.col("doc_id").isNotNull() & (F.pmod(F.col("_sum"), F.lit(every)) == 0)
    return found.withColumn("_sum", sum_).withColumn("run", F.when(slips, cut).otherwise(F.col("run"))).drop("_sum")


def count_words(found: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): the distinct runs that are long and frequent enough."""
    counted = found.where(F.length("run") >= least_length).groupBy(F.col("run").alias("word"))
    return counted.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, word, n, long, first): the members of every prefix range.

    ``long`` is true where the key lacks the rotation's last character; ``first`` where that
    character is not the repeat of the one in front of it.
    """
    word, size = F.col("word"), F.length("word")

    def cut(start: Column, end: Column) -> Column:
        return F.substring(word, start + 1, end - start)

    def member(key: Column, long: bool, first: Column) -> Column:
        return F.struct(key.alias("key"), F.lit(long).alias("long"), first.alias("first"))

    def without(i: Column) -> Column:
        key = F.concat(cut(i + 1, size), F.lit(END), cut(F.lit(0), i))
        return member(key, True, (i == 0) | (cut(i, i + 1) != cut(i - 1, i)))

    def whole(i: Column) -> Column:
        return member(F.concat(cut(i, size), F.lit(END), cut(F.lit(0), i)), False, F.lit(False))

    places = F.sequence(F.lit(0), size - 1)
    both = F.concat(F.transform(places, without), F.transform(F.sequence(F.lit(0), size), whole))
    return words.select("word", "n", F.explode(both).alias("m")).select("m.key", "word", "n", "m.long", "m.first")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): how many words are near, and the most frequent of them.

    Words that none is near to have no row.
    """
    scan = Window.partitionBy("key").orderBy(F.desc("long"), F.desc("n"), "word")
    group = scan.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    this = F.struct((-F.col("n")).alias("less"), "word")
    seen = rotations(words).select(
        "word",
        "long",
        "first",
        F.row_number().over(scan).alias("place"),
        F.count(F.when(F.col("long"), 1)).over(group).alias("longs"),
        F.count(F.when(F.col("first"), 1)).over(group).alias("firsts"),
        F.first(F.when(F.col("long"), this), ignorenulls=True).over(group).alias("best"),
        F.nth_value(F.when(F.col("long"), this), 2).over(group).alias("second"),
        F.first(F.when(F.col("first"), this), ignorenulls=True).over(group).alias("best_first"),
        F.first(F.when(~F.col("long"), this), ignorenulls=True).over(group).alias("whole"),
    )
    other = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("best"))
    shorter = F.when(F.col("first"), F.col("whole"))
    member = seen.select(
        "word",
        F.when(F.col("long"), F.col("longs") - 1 + shorter.isNotNull().cast("long")).otherwise(F.col("firsts")).alias("n"),
        F.when(F.col("long"), F.least(other, shorter)).otherwise(F.col("best_first")).alias("near"),
    ).where("n > 0")
    found = member.groupBy("word").agg(F.sum("n").alias("n_near"), F.min("near").alias("near"))
    return found.select("word", "n_near", F.col("near.word").alias("near"), (-F.col("near.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last.

    A form is at least twice as frequent as its word, so a chain has at most as many links as
    the greatest count has binary digits; a round takes every open chain one link on, and
    chains that ended leave the rounds.
    """
    forms = cut_lineage(forms)
    step = forms.select(F.col("word").alias("_at"), F.col("form").alias("_next"))
    open_, done = forms.select("word", F.col("form").alias("_at")), []
    while not open_.isEmpty():
        open_ = cut_lineage(open_.join(step, "_at", "left"))
        done.append(open_.where("_next IS NULL").select("word", F.col("_at").alias("root")))
        open_ = open_.where("_next IS NOT NULL").select("word", F.col("_next").alias("_at"))
    ended = open_.select("word", F.col("_at").alias("root"))
    for part in done:
        ended = ended.unionByName(part)
    return ended


def spelling_groups(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a word table (word, n).

    ``form`` is the most frequent near word (ties: the least in code point order) if it is at
    least ``times`` (2 or more) as frequent as the word, else NULL; ``root`` is the last form
    of the chain that starts at the word.
    """
    usable = words.where(F.col("word").isNotNull() & (F.instr("word", END) == 0) & (F.length("word") > 0))
    known = cut_lineage(usable.groupBy("word").agg(F.sum("n").alias("n")))
    better = F.col("near_n") >= times * F.col("n")
    marked = cut_lineage(
        known.join(near_words(known), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(better, F.col("near")).alias("form"),
            F.when(better, F.col("near_n")).alias("form_n"),
        )
    )
    last = roots(marked.where("form IS NOT NULL").select("word", "form"))
    return marked.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
