import json
import warnings
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import types as T

from blockprep import PrepConfig, prepare
from blockprep.operators.messages import message_rows, prompt_messages
from blockprep.sources.instructions import load_instructions, resolve_source, write_jsonl
from blockprep.sources.prepared import check_manifest, write_views
from blockprep.sources.storage import cut_lineage, shared_folder, spread

KEY = T.StructField("id", T.LongType())


def test_jsonl_keeps_nulls_and_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é漢")], "id long, prompt string")
    path = str(tmp_path / "deep" / "rows")
    assert write_jsonl(df, path) == 2
    lines = [json.loads(x) for p in Path(path).glob("part-*") for x in p.read_text("utf-8").splitlines()]
    assert sorted(lines, key=lambda r: r["id"]) == [{"id": 1, "prompt": None}, {"id": 2, "prompt": "é漢"}]
    assert write_jsonl(df.limit(1), path) == 1  # overwritten


def test_files_win_over_dataset(spark, tmp_path):
    assert resolve_source("name", "f.jsonl") == ("files", "f.jsonl")
    assert resolve_source("name", "") == ("dataset", "name")
    with pytest.raises(ValueError):
        resolve_source(None, None)
    rows = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "id long, prompt string, split string")
    folder, files = str(tmp_path / "mirror"), str(tmp_path / "files")
    write_jsonl(rows, folder, ["split"])
    write_jsonl(rows.drop("split"), files)
    test = load_instructions(spark, dataset=folder, split="test", keys=[KEY])
    assert [r.id for r in test.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().toString()
    assert load_instructions(spark, dataset=folder, data_files=files, keys=[KEY]).count() == 2
    assert load_instructions(spark, dataset=files, keys=[KEY]).count() == 2  # no splits: whole


def test_manifest(spark, tmp_path):
    cfg = PrepConfig()
    path = str(tmp_path / "views")
    with pytest.warns(UserWarning, match="no stamp"):
        assert not check_manifest(spark, path, cfg)
    views = spark.createDataFrame([(0, 1), (1, 2)], "epoch int, batch_id long")
    write_views(views, path, cfg)
    write_views(views.where("epoch = 1"), path, cfg)  # replaces its own epoch only
    assert spark.read.parquet(path).count() == 2
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert check_manifest(spark, path, cfg)
    with pytest.warns(UserWarning, match="not prepared with these settings"):
        assert not check_manifest(spark, path, replace(cfg, block_size=8))


def test_prepare_writes_everything(spark, tmp_path):
    cfg = PrepConfig(block_size=4, context_length=16, vocab_size=20, micro_batch=2)
    prompts = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "sample_id long, text string")
    path = str(tmp_path / "out")
    prepare(message_rows(prompt_messages(prompts, "text", ["sample_id"])), cfg, path)
    views = spark.read.parquet(f"{path}/views")
    assert views.count() == 6 and {len(r.input_ids) for r in views.collect()} == {16}
    assert check_manifest(spark, f"{path}/views", cfg)
    assert spark.read.parquet(f"{path}/vocab").where("is_special").count() == 5


def test_settings_are_checked():
    for bad in ({"block_size": 0}, {"vocab_size": 0}, {"vocab_size": 10**9}):
        with pytest.raises(ValueError):
            PrepConfig(**bad)
    assert PrepConfig().padding_id == 1 and PrepConfig(pad_id=9).padding_id == 9


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, master, settings):
        self.sparkContext = FakeContext(master)
        self.conf = settings


def test_named_folder_is_used_and_required_on_a_cluster():
    named = FakeSession("spark://host:7077", {"spark.checkpoint.dir": "/shared/x"})
    assert shared_folder(named) == "/shared/x" == named.sparkContext.folder
    with pytest.raises(RuntimeError):
        shared_folder(FakeSession("spark://host:7077", {}))


def test_lineage_cut_and_spread(spark):
    assert shared_folder(spark)
    assert cut_lineage(spark.range(10)).count() == 10
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 8
    many = spark.range(10).repartition(20)
    assert spread(many) is many
