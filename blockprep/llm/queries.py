"""The operators of this subpackage as queries, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockprep.llm import (
    bpe,
    decontaminate,
    linededup,
    lm,
    minhash,
    negatives,
    pages,
    sharding,
    spelling,
    token_counts,
    topk,
    toxicity,
    urls,
)
from blockprep.llm.oracles import ORACLES

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    sharded = sharding.shard_documents(_table(spark, folder, "documents"))
    return sharded.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.section_rows(token_counts.count_tokens(docs, BPE_RANKS))


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    extracted = pages.extract_text(_table(spark, folder, "pages"))
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contamination(docs, _table(spark, folder, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending")
    )


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, BPE_RANKS).drop("text")
    return bpe.decode(encoded, BPE_RANKS).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_documents(_table(spark, folder, "documents"))


#: Site rules of the URL query, and pattern rules for pages that none of them fits.
SITE_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
URL_PATTERNS = [
    ("||ads-track.", "block"),
    ("||ads.", "block"),
    ("||tracker.", "block"),
    ("/login^", "block"),
    ("/search?", "block"),
    ("^sessionid=", "block"),
    ("||m.*/print/", "block"),
    ("||blog.*/de/*.html|", "block"),
    (".exe|", "block"),
    (".zip|", "block"),
    ("/de/*#top|", "allow"),
]


def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.filter_urls(
        _table(spark, folder, "pages"),
        urls.rule_table(spark, SITE_RULES),
        urls.rule_table(spark, URL_PATTERNS),
        spread_by="page_id",
    )
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern")


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    words = spelling.count_words(spelling.with_slips(spelling.runs(docs), 97))
    return spelling.spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    slipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", slipped), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_minhash": op2_minhash,
    "op3_topk": op3_topk,
    "op4_token_counts": op4_token_counts,
    "op5_html_text": op5_html_text,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_url_filter": op11_url_filter,
    "op12_spelling": op12_spelling,
    "op13_hard_negatives": op13_hard_negatives,
}

__all__ = ["ORACLES", "QUERIES"]
