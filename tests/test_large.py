"""What changes with size: numbering, joins of frequent keys, step plans, stores of many epochs."""

import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from blockprep.config import BYTE_NAME, PrepConfig
from blockprep.functions.hashing import grid_of, permuted
from blockprep.operators import heavy, packing, running, tokens, vocabulary
from blockprep.operators.messages import message_rows, prompt_messages
from blockprep.plans import prepare
from blockprep.sources import prepared
from blockprep.streaming import ingest

CFG = PrepConfig(context_length=32, block_size=8, vocab_size=60)


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 5003])
def test_permutations_are_bijections(spark, n):
    a, b = grid_of(n)
    assert n <= a * b < n + a
    made = spark.range(n).select(
        permuted(F.col("id"), n, 42, F.lit(0)).alias("x"), permuted(F.col("id"), n, 42, F.lit(1)).alias("y")
    ).collect()
    assert sorted(r.x for r in made) == sorted(r.y for r in made) == list(range(n))
    if n > 900:
        assert sum(r.x == r.y for r in made) < 20
        assert sum(abs(p.x - q.x) == 1 for p, q in zip(made, made[1:])) < 20


def test_step_plan_covers_epochs(spark):
    cfg = replace(CFG, micro_batch=3)
    samples = spark.range(100, 111).withColumnRenamed("id", "sample_id")
    plan = packing.step_plan(samples, cfg, 4, 2).collect()
    assert sorted({r.micro for r in plan}) == list(range(8)) and all(r.step == r.micro // 2 for r in plan)
    for epoch in (0, 1):
        part = [r for r in plan if r.epoch == epoch]
        assert sorted(r.sample_id for r in part) == list(range(100, 111))
        assert Counter(Counter(r.micro for r in part).values()) == {3: 3, 2: 1}
    assert packing.step_plan(samples.limit(0), cfg, 4, 2).count() == 0
    assert packing.step_plan(samples, cfg, 0, 2).count() == 0


def test_numbered_samples_are_planned_without_a_shuffle(spark):
    samples = spark.range(5000).selectExpr("id + 7 AS sample_id", "id AS number")
    plan = packing.step_plan(samples, CFG, 60, 10, index="number")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 600 and plan.select("sample_id").distinct().count() == 600


def test_heavy_join(spark):
    rng = random.Random(1)
    keys = ["hot"] * 6000 + [f"k{rng.randrange(900)}" for _ in range(2000)] + [None] * 2000
    rng.shuffle(keys)
    df = spark.createDataFrame(list(enumerate(keys)), "i long, token string").repartition(8)
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i + 2) for i in range(0, 900, 2)], "token string, token_id int")
    assert [r.token for r in heavy.heavy_keys(df, "token", 1).collect()] == ["hot"]
    joined = heavy.heavy_join(df, table, "token", 1)
    assert sorted(map(tuple, joined.select("i", "token_id").collect())) == sorted(
        map(tuple, df.join(table, "token", "left").select("i", "token_id").collect())
    )
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.3 * len(keys)
    # Without the split, every row of the frequent key meets in one task.
    plain = df.join(table.hint("merge"), "token", "left").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in plain) > 0.5 * len(keys)
    assert heavy.heavy_join(df.limit(0), table, "token").count() == 0


def test_tokens_meet_a_large_vocabulary_the_same_way(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("the of a zebra quilt övn".split()) + str(rng.randrange(9)) for _ in range(12))) for i in range(40)]
    rows = message_rows(prompt_messages(spark.createDataFrame(rows, "sample_id long, text string"), "text", ["sample_id"]))
    small = prepare.corpus_vocab(rows, CFG)
    expected = tokens.tokenize(rows, small, CFG).collect()
    text = tokens.detokenize(tokens.tokenize(rows, small, CFG), small, CFG, ["sample_id"]).collect()
    for module in (tokens, vocabulary):
        monkeypatch.setattr(module, "BROADCAST_VOCAB", 10)
    large = prepare.corpus_vocab(rows, CFG)
    assert sorted(large.collect()) == sorted(small.collect())
    assert sorted(tokens.tokenize(rows, large, CFG).collect()) == sorted(expected)
    assert sorted(tokens.detokenize(tokens.tokenize(rows, large, CFG), large, CFG, ["sample_id"]).collect()) == sorted(text)


def test_sorted_numbers(spark):
    df = spark.range(3000).selectExpr("id", "id * 7919 % 13 AS n").repartition(5)
    numbered = running.sorted_numbers(df, [F.desc("n"), F.col("id")], "at").collect()
    assert [r.id for r in sorted(numbered, key=lambda r: r["at"])] == [r.id for r in sorted(numbered, key=lambda r: (-r.n, r.id))]
    assert sorted(r["at"] for r in numbered) == list(range(3000))


def test_places_and_ids_beyond_one_long(spark, monkeypatch):
    monkeypatch.setattr(tokens, "PLACE_SPAN", 5)
    rows = spark.createDataFrame([(1, k, "user", f"a b{k}") for k in range(3)], "sample_id long, ord int, role string, content string")
    vocab = prepare.corpus_vocab(rows, CFG)
    cut = tokens.token_ids(rows, vocab, CFG).first().input_ids
    monkeypatch.undo()
    assert cut == tokens.token_ids(rows, vocab, CFG).first().input_ids


def test_supplied_byte_rows_must_be_whole(spark):
    cfg = CFG
    rows = [("<|endoftext|>", 1, False), ("a", 2, False)] + [(BYTE_NAME % f"{b:02X}", 10 + b, False) for b in range(256)]
    make = lambda r: spark.createDataFrame(r, "token string, token_id int, is_special boolean")
    _, bound = vocabulary.bind_vocab(make(rows), cfg)
    assert bound.byte_fallback and bound.byte_base == 10
    gap = [r if r[0] != BYTE_NAME % "41" else (r[0], 900, False) for r in rows]
    with pytest.raises(ValueError):
        vocabulary.bind_vocab(make(gap), cfg)
    _, bound = vocabulary.bind_vocab(make(gap + [("<unk>", 3, False)]), cfg)
    assert not bound.byte_fallback and bound.unknown_id == 3


def stored(spark, path, cfg):
    rows = spark.createDataFrame([(i, f"text {i} of {i % 3}") for i in range(30)], "sample_id long, text string")
    messages = message_rows(prompt_messages(rows, "text", ["sample_id"]))
    for epoch in (0, 1):
        prepare.prepare(messages, cfg, path, epoch)
    return messages


def test_epochs_stand_beside_each_other(spark, tmp_path):
    path = str(tmp_path / "store")
    messages = stored(spark, path, CFG)
    views = spark.read.parquet(f"{path}/views")
    assert {r.epoch: r["count"] for r in views.groupBy("epoch").count().collect()} == {0: 60, 1: 60}
    first = sorted(map(tuple, views.where("epoch = 0").drop("epoch").collect()))
    vocab = prepared.read_vocab(spark, f"{path}/vocab")
    assert first == sorted(map(tuple, prepare.views(messages, vocab, CFG, 0).collect()))
    prepare.prepare(messages, CFG, path, 1)
    assert sorted(map(tuple, spark.read.parquet(f"{path}/views").where("epoch = 0").drop("epoch").collect())) == first
    order = [r.batch_id for r in prepare.stored_batches(spark, CFG, path, 0).orderBy("sample_id").collect()]
    assert order != [r.batch_id for r in prepare.stored_batches(spark, CFG, path, 1).orderBy("sample_id").collect()]


def test_stored_ids_stay_where_they_are(spark, tmp_path):
    path = str(tmp_path / "store")
    stored(spark, path, CFG)
    # Another session's catalog does not know the table: its files are named there first.
    spark.sql(f"DROP TABLE {prepared._ids_table(f'{path}/ids')}")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = prepare.stored_batches(spark, CFG, path, 1)
        plan = joined._jdf.queryExecution().executedPlan()
        lines = plan.toString().splitlines()
        at = next(i for i, line in enumerate(lines) if "FileScan" in line and "input_ids" in line)
        above = next(i for i in range(at, -1, -1) if "SortMergeJoin" in lines[i])
        assert not any("Exchange" in line for line in lines[above:at]) and "Bucketed: true" in lines[at]
        assert joined.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_readers_see_committed_triggers_only(spark, tmp_path):
    path = str(tmp_path / "views")
    rows = spark.createDataFrame([(1, 2)], "batch_id long, view int")
    for trigger in (0, 1):
        rows.write.parquet(f"{path}/trigger={trigger}")
    assert ingest.read_ingested_views(spark, path).count() == 0
    prepared.commit_trigger(spark, path, 0)
    assert ingest.read_ingested_views(spark, path).count() == 1
    # The stream that fell over before its commit runs again, writes anew and commits.
    rows.write.mode("overwrite").parquet(f"{path}/trigger=1")
    prepared.commit_trigger(spark, path, 1)
    prepared.commit_trigger(spark, path, 1)
    assert ingest.read_ingested_views(spark, path).count() == 2
