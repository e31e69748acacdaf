"""The shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: How many times a shuffle's partitions ``finer_parts`` are.
FINER = 4


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Without that setting a temporary folder serves a local session; on a
    cluster a machine-local folder would not be visible to every executor,
    so the setting is required there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="blockprep-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the reliable checkpoint folder and continue from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Give per-row text work enough tasks when a source comes in few pieces.

    A table in many files already has its tasks and stays as it is; only one
    that would leave cores idle (one big row group, an unsplittable archive)
    is dealt out once.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def deal(df: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """Rows of a key together in ``parts`` tasks, a number that is kept.

    What a shuffle deals out by itself is joined to fewer tasks by its compressed bytes, of which
    exploded and sorted rows take many times as much memory.
    """
    return df.repartition(max(parts, 1), *keys)


def finer_parts(spark: SparkSession) -> int:
    """Parts for rows that are sorted several times in one task: more than a shuffle has."""
    return FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
