import json
import random

import pytest
from pyspark.sql import types as T

from blockprep.plans import registry
from blockprep.sources.arrays import json_records, read_json_array
from blockprep.sources.instructions import read_instructions

KEY = T.StructField("sample_id", T.LongType())


def objects(n=120, seed=1):
    rng = random.Random(seed)
    odd = ['"', "\\", "}", "{", "[", "]", ",", '\\"', "\n", "é", "👍", "}{", '"}', ": "]
    out = []
    for i in range(n):
        text = "".join(rng.choice(odd + ["word "]) for _ in range(rng.randrange(40)))
        out.append({"sample_id": i, "prompt": text, "messages": [{"role": "user", "content": text[::-1]}] * (i % 3)})
    return out


def as_files(tmp_path, rows):
    texts = {
        "pretty": json.dumps(rows, indent=2),
        "flat": "﻿ " + json.dumps(rows, ensure_ascii=False, separators=(",", ":")) + "\n\n",
        "lines": "\n".join(json.dumps(r) for r in rows),
        "single": json.dumps(rows[0], indent=1),
        "empty": " [ ] ",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    return {name: str(tmp_path / f"{name}.json") for name in texts}


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_of_all_layouts(spark, tmp_path, small_ranges):
    rows = objects()
    files = as_files(tmp_path, rows)
    for name, path in files.items():
        expected = {"single": rows[:1], "empty": []}.get(name, rows)
        found = [json.loads(r.text) for r in json_records(spark, path).orderBy("record").collect()]
        assert found == expected, name
    everything = json_records(spark, list(files.values())).count()
    assert everything == 3 * len(rows) + 1


def test_same_rows_as_a_whole_file_read(spark, tmp_path, small_ranges):
    path = as_files(tmp_path, objects(60, 2))["pretty"]
    order = lambda df: sorted(df.collect(), key=lambda r: r.sample_id)
    assert order(read_json_array(spark, path, [KEY])) == order(read_instructions(spark, path, True, [KEY]))


def test_the_tasks_grow_with_the_file(spark, tmp_path, small_ranges):
    def tasks(n, name):
        path = tmp_path / name
        path.write_text(json.dumps(objects(n), indent=2))
        return spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions(), path.stat().st_size

    (few, small), (many, large) = tasks(30, "a"), tasks(300, "b")
    assert few > 4 and many > 0.6 * few * large / small


def test_cut_and_odd_files(spark, tmp_path):
    cases = {
        "cut": '[{"prompt": "a"}, {"prompt": "b',
        "bad": '[{"prompt": "a"}, {"prompt": }, {"prompt": "c"}]',
        "values": '[1, {"prompt": "a"}]',
    }
    got = {}
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
        rows = read_json_array(spark, str(tmp_path / name)).collect()
        got[name] = sorted((r.prompt or "", (r._corrupt_record or "")[:12]) for r in rows)
    assert got["cut"] == [("", '{"prompt": "'), ("a", "")]
    assert got["bad"] == [("", '{"prompt": }'), ("a", ""), ("c", "")]
    assert got["values"] == [("", '1, {"prompt"')]


def test_large_array_is_written_by_many_tasks_each_a_whole_array(spark, tmp_path, monkeypatch):
    docs = [(i, f"a {{]\\\" {i}\nb", "en", f"src{i % 2}") for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(registry, "new_path", lambda _spark, name: f"{tmp_path}/{name}")
    got = registry.large_array(spark, str(tmp_path))
    files = [f.read_text() for f in (tmp_path / "array").glob("part-*")]
    held = [[o["sample_id"] for o in json.loads(text) if o["sample_id"] >= 0] for text in files]
    assert sorted(i for ids in held for i in ids) == list(range(200))
    assert max(map(len, held)) <= 50
    assert sorted(got.collect()) == sorted(registry.render(spark, str(tmp_path)).select("sample_id", "digest").collect())
