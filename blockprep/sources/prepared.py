"""Prepared tables on disk and the stamp that says how they were made."""

from __future__ import annotations

import hashlib
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockprep.config import LABEL_SHIFT, VOCAB_SCHEMA, PrepConfig

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("mask_id", T.IntegerType()),
        T.StructField("block_size", T.IntegerType()),
        T.StructField("base_name", T.StringType()),
        T.StructField("label_shift", T.StringType()),
    ]
)


def _stamp(cfg: PrepConfig) -> tuple[int, int, str, str]:
    return cfg.mask_id, cfg.block_size, cfg.base_name, LABEL_SHIFT


def _manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}/_manifest"


def write_manifest(spark: SparkSession, path: str, cfg: PrepConfig) -> None:
    """Write the one-row stamp next to the data (readers skip ``_`` folders)."""
    spark.createDataFrame([_stamp(cfg)], MANIFEST_SCHEMA).write.mode("overwrite").parquet(
        _manifest_path(path)
    )


def check_manifest(spark: SparkSession, path: str, cfg: PrepConfig) -> bool:
    """Compare the stamp with the settings; warn and return False when it differs."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).parquet(_manifest_path(path)).take(1)
    except AnalysisException:
        rows = []
    if rows and tuple(rows[0]) == _stamp(cfg):
        return True
    differs = "it has no stamp"
    if rows:
        pairs = zip(MANIFEST_SCHEMA.names, rows[0], _stamp(cfg))
        differs = "; ".join(f"{name} is {own!r} there and {wanted!r} here" for name, own, wanted in pairs if own != wanted)
    warnings.warn(
        f"{path} was not prepared with these settings: {differs}; plans.prepare.prepare writes it anew", stacklevel=2
    )
    return False


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A stored vocabulary of any size; how it is joined depends on ``vocab_size``."""
    return spark.read.schema(VOCAB_SCHEMA).parquet(path)


def _ids_table(path: str) -> str:
    return f"blockprep_ids_{hashlib.md5(path.encode()).hexdigest()}"


def write_ids(samples: DataFrame, path: str, buckets: int) -> None:
    """Store (sample_id, input_ids) once, in buckets of ``sample_id``."""
    spark, name = samples.sparkSession, _ids_table(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = samples.select("sample_id", "input_ids").write.mode("overwrite").format("parquet")
    writer.bucketBy(buckets, "sample_id").sortBy("sample_id").option("path", path).saveAsTable(name)
    counted = spark.range(1).select(F.lit(buckets).alias("buckets"))
    counted.write.mode("overwrite").parquet(f"{path.rstrip('/')}_buckets")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The stored ids with their buckets, so that a join on ``sample_id`` leaves them in place.

    A session that has not written them names the files in its own catalog first.
    """
    name = _ids_table(path)
    if not spark.catalog.tableExists(name):
        buckets = spark.read.parquet(f"{path.rstrip('/')}_buckets").first()["buckets"]
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (sample_id) SORTED BY (sample_id) "
            f"INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def commit_trigger(spark: SparkSession, path: str, trigger: int) -> None:
    """Say that a trigger's folders are whole; written after them."""
    done = spark.range(1).select(F.lit(trigger).cast("long").alias("committed"))
    done.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_commits/{trigger}")


def committed_triggers(df: DataFrame, path: str) -> DataFrame:
    """The rows (with their ``trigger``) of triggers that are whole."""
    spark = df.sparkSession
    try:
        done = spark.read.schema("committed long").option("recursiveFileLookup", "true").parquet(f"{path.rstrip('/')}/_commits")
    except AnalysisException:
        return df.limit(0)
    return df.join(F.broadcast(done), F.col("trigger") == F.col("committed"), "left_semi")


def write_views(views: DataFrame, path: str, cfg: PrepConfig, mode: str = "overwrite") -> None:
    """Store views as parquet, one folder per epoch when they carry one."""
    writer = views.write.mode(mode)
    if "epoch" in views.columns:
        writer = writer.partitionBy("epoch").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    write_manifest(views.sparkSession, path, cfg)
