"""A corpus pipeline: from ``documents`` to token ids, in stages that each take the last one's rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockprep.llm import bpe, decontaminate, linededup, minhash, toxicity
from blockprep.sources.storage import new_path

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


#: Rows of an Arrow batch: whole texts, held by the JVM and by a worker at once.
BATCH_ROWS = "500"
#: Slices that an encoder remembers; workers live on from stage to stage, so tasks let theirs go.
SLICES = 40_000


def _stage(work: Callable) -> Callable:
    """A stage on columns ``doc_id``, ``text`` and x0, x1, ..., which get their names back.

    So no name of a document column is in an operator's way, whatever it is.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        names = docs.columns
        plain = docs.toDF(*[n if n in ("doc_id", "text") else f"x{i}" for i, n in enumerate(names)])
        return work(spark, plain, sf_dir, names).select(*plain.columns).toDF(*names)

    run.__name__, run.__doc__ = work.__name__, work.__doc__
    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, names: list[str]) -> DataFrame:
    """Documents that are not predicted toxic; the model learns from the labels of these documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0")


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str, names: list[str]) -> DataFrame:
    """Texts without runs of lines that stand earlier; a document that is nothing else goes.

    ``n_chars``, where there is such a number, follows the text.
    """
    left = linededup.dedup_lines(docs).where(
        "NOT coalesce(n_removed > 0 AND trim(translate(text, '\n\r\t', '')) = '', false)"
    )
    for i, name in enumerate(names):
        if name == "n_chars" and isinstance(docs.schema[f"x{i}"].dataType, T.NumericType):
            chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(f"x{i}"))
            left = left.withColumn(f"x{i}", chars.cast(docs.schema[f"x{i}"].dataType))
    return left


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, names: list[str]) -> DataFrame:
    """One document of each near-duplicate group; of rows that share id and text, one."""
    named = docs.where("doc_id IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    key = ["doc_id", "text_hash"]
    found = minhash.marked_texts(named).where("kept").select(*key).distinct()
    kept = named.join(found, key, "left_semi").dropDuplicates(key).drop("text_hash")
    return kept.unionByName(docs.where("doc_id IS NULL"))


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str, names: list[str]) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.mark_contamination(docs, items).where("n_hit = 0")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of them and of the bytes they decode to."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    encoded = bpe.encode(docs.select("doc_id", "text"), BPE_RANKS, slices=SLICES).drop("text")
    return bpe.decode(encoded, BPE_RANKS).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", to_tokens),
]

#: A trained classifier and a tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
