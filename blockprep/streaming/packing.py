"""Contexts of several samples out of a stream, the same however it is cut into triggers.

Which samples share a context must not hang on which of them came first.  So samples gather by
event time and a hash of their id; a group stays open in the state store until the watermark has
passed its time, and is then put in the order of its hashes and cut into micro-batches.  Samples
that come again, as a replayed trigger may bring them, count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockprep.config import PrepConfig
from blockprep.functions.arrays import fit_context, pad_block, truncate
from blockprep.functions.hashing import hash_key, hash_word
from blockprep.operators.messages import message_rows, to_messages
from blockprep.operators.tokens import tokenize
from blockprep.sources.prepared import read_vocab

SAMPLE_SCHEMA = "sample_id long, input_ids array<int>, at timestamp"


def ingest_samples(rows: DataFrame, vocab_path: str, cfg: PrepConfig, path: str, checkpoint: str) -> StreamingQuery:
    """Tokenize new rows (with ``sample_id`` and an event time ``at``) into a folder of samples."""

    def write(batch: DataFrame, trigger: int) -> None:
        vocab = read_vocab(batch.sparkSession, vocab_path)
        coded = tokenize(message_rows(to_messages(batch.drop("at"))), vocab, cfg)
        timed = coded.join(batch.select("sample_id", "at"), "sample_id")
        timed.select("sample_id", "input_ids", "at").write.mode("overwrite").parquet(f"{path}/trigger={trigger}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pack_windows(samples: DataFrame, cfg: PrepConfig, width: str, groups: int) -> DataFrame:
    """Samples (sample_id, input_ids, at) to contexts (batch_id, input_ids), batch or stream.

    ``width`` is the length of a time window and ``groups`` the number of hash groups it is cut
    into, to be chosen so that a group (which is one row in the end) stays small.
    """
    order = F.struct(hash_key(cfg.seed, "pack", F.col("sample_id")).alias("h"), "sample_id", "input_ids")
    group = F.pmod(hash_word(cfg.seed, "group", F.col("sample_id")), F.lit(groups)).alias("part")
    gathered = samples.groupBy(F.window("at", width).alias("time"), group).agg(F.array_sort(F.collect_list(order)).alias("s"))
    size = F.lit(cfg.micro_batch)
    chunks = F.sequence(F.lit(0), F.ceil(F.size("s") / size).cast("int") - 1)

    def padded(sample):
        return pad_block(truncate(sample["input_ids"], cfg.context_length), cfg.block_size, cfg.mask_id)

    def context(number):
        return F.struct(
            number.alias("number"), F.flatten(F.transform(F.slice("s", number * size + 1, size), padded)).alias("ids")
        )

    cut = gathered.select(F.unix_timestamp("time.start").alias("start"), "part", F.explode(F.transform(chunks, context)).alias("c"))
    ids = fit_context("c.ids", cfg.context_length, cfg.mask_id) if cfg.pad_to_context else F.col("c.ids")
    return cut.select(F.concat_ws("-", "start", "part", "c.number").alias("batch_id"), ids.alias("input_ids"))


def pack_stream(
    spark: SparkSession, samples: str, cfg: PrepConfig, path: str, checkpoint: str, width: str, groups: int, delay: str
) -> StreamingQuery:
    """Pack the samples of a folder as they arrive and append closed contexts as parquet.

    ``delay`` says how late a sample may come after others of a later time; what comes later
    still is left out, as with any watermark.  Groups that are open when the stream stops are
    in its checkpoint, and go on when it is started again.
    """
    arriving = spark.readStream.schema(SAMPLE_SCHEMA + ", trigger int").parquet(samples).drop("trigger")
    once = arriving.withWatermark("at", delay).dropDuplicatesWithinWatermark(["sample_id"])
    return (
        pack_windows(once, cfg, width, groups)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
