"""The preparation steps on files that keep arriving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from blockprep.config import PrepConfig
from blockprep.functions.text import render_chat
from blockprep.operators.messages import message_rows, rejected_rows, to_messages
from blockprep.operators.tokens import tokenize
from blockprep.operators.packing import pack
from blockprep.operators.views import complementary_views
from blockprep.sources.instructions import INSTRUCTION_SCHEMA
from blockprep.sources.prepared import commit_trigger, committed_triggers, read_vocab, write_manifest


def stream_instructions(
    spark: SparkSession,
    folder: str,
    keys: Sequence[T.StructField],
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Instruction rows of a folder that receives JSON Lines files."""
    schema = T.StructType([*keys, *INSTRUCTION_SCHEMA.fields])
    reader = spark.readStream.schema(schema).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def ingest_rendered(rows: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Normalise and render new rows and append them as parquet; keeps no state."""
    rendered = to_messages(rows, keys).select(*keys, render_chat("messages").alias("text"))
    return (
        rendered.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_rejects(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the new rows that have no message form as JSON Lines; run it beside the others."""
    return (
        rejected_rows(rows)
        .writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_views(
    rows: DataFrame,
    vocab_path: str,
    cfg: PrepConfig,
    path: str,
    checkpoint: str,
    rejects: str | None = None,
) -> StreamingQuery:
    """Tokenize, pack and mask new rows against a stored, frozen vocabulary.

    Every sample is its own context, keyed by its id: the result does not
    depend on which trigger a sample arrived in, and equals the batch result.
    Each trigger owns one output folder and overwrites it, so a replayed
    trigger leaves no duplicates; it is committed after all its folders are
    written, and readers take committed triggers only.  Rows without a message form go to ``rejects``.
    """
    if cfg.micro_batch != 1:
        raise ValueError("incremental views pack one sample per context")
    write_manifest(rows.sparkSession, path, cfg)

    def write(batch: DataFrame, trigger: int) -> None:
        vocab = read_vocab(batch.sparkSession, vocab_path)
        views = sample_views(message_rows(to_messages(batch)), vocab, cfg)
        views.write.mode("overwrite").parquet(f"{path}/trigger={trigger}")
        if rejects is not None:
            rejected_rows(batch).write.mode("overwrite").json(f"{rejects}/trigger={trigger}")
        commit_trigger(batch.sparkSession, path, trigger)

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def sample_views(messages: DataFrame, vocab: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Views with one context per sample, ``batch_id`` being the sample id."""
    samples = tokenize(messages, vocab, cfg).withColumn("batch_id", F.col("sample_id"))
    return complementary_views(pack(samples.withColumn("slot", F.lit(0)), cfg), cfg)


def read_ingested_views(spark: SparkSession, path: str) -> DataFrame:
    """All views of committed triggers."""
    return committed_triggers(spark.read.parquet(path), path).drop("trigger")


def tail_state_log(spark: SparkSession, log: str, key_type: str = "bigint") -> DataFrame:
    """Stream of the slots a running ``fill(..., log=...)`` has filled."""
    schema = f"seq_id {key_type}, step int, pos int, token_id int, from_step int"
    return spark.readStream.schema(schema).parquet(log).drop("from_step")
