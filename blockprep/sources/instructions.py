"""Instruction rows in and out: JSON / JSON Lines files and mirrored datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


# Declared, never inferred: with inference one odd row would turn a whole
# list column into text.
INSTRUCTION_SCHEMA = T.StructType(
    [
        T.StructField("messages", T.ArrayType(T.StructType(_strings("role", "content")))),
        T.StructField(
            "conversations",
            T.ArrayType(T.StructType(_strings("role", "from", "content", "value"))),
        ),
        *_strings(
            "instruction",
            "prompt",
            "question",
            "input",
            "output",
            "response",
            "answer",
            "_corrupt_record",
        ),
    ]
)


def _schema_with(keys: Sequence[T.StructField]) -> T.StructType:
    return T.StructType([*keys, *INSTRUCTION_SCHEMA.fields])


def read_instructions(
    spark: SparkSession,
    paths: str | Sequence[str],
    multiline: bool = False,
    keys: Sequence[T.StructField] = (),
) -> DataFrame:
    """Read JSON Lines (or, with ``multiline``, JSON arrays) of instruction rows.

    ``keys`` names further columns to read, such as a sample id.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (
        spark.read.schema(_schema_with(keys))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("multiLine", str(multiline).lower())
        .json(paths)
    )


def read_dataset(
    spark: SparkSession, folder: str, split: str, keys: Sequence[T.StructField] = ()
) -> DataFrame:
    """One split of a dataset mirrored as JSON Lines under ``split=<name>`` folders."""
    return select_split(read_instructions(spark, folder, keys=keys), split)


def select_split(df: DataFrame, split: str) -> DataFrame:
    """The rows of one split; prunes folders when ``split`` is a partition column.

    A dataset without splits is returned whole.
    """
    if "split" not in df.columns:
        return df
    return df.where(F.col("split") == split).drop("split")


def resolve_source(dataset: str | None, data_files: str | Sequence[str] | None) -> tuple[str, str | Sequence[str]]:
    """('files', paths) when file paths are given, else ('dataset', name)."""
    if data_files:
        return "files", data_files
    if dataset:
        return "dataset", dataset
    raise ValueError("name a dataset or give data files")


def load_instructions(
    spark: SparkSession,
    dataset: str | None = None,
    split: str = "train",
    data_files: str | Sequence[str] | None = None,
    keys: Sequence[T.StructField] = (),
    multiline: bool = False,
) -> DataFrame:
    """Rows from files, or from the split of a mirrored dataset; files win.

    ``multiline`` reads files that hold one JSON value over many lines.
    """
    kind, source = resolve_source(dataset, data_files)
    if kind == "files":
        return read_instructions(spark, source, multiline, keys)
    return read_dataset(spark, source, split, keys=keys)


def write_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Write JSON Lines part files, NULL fields included; returns the rows written.

    The count is taken while writing, so the input is not read twice.
    """
    observation = Observation()
    writer = (
        df.observe(observation, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("ignoreNullFields", "false")
        .option("encoding", "UTF-8")
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)
    return observation.get["rows"]
