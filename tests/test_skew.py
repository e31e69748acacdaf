"""One conversation holds most of the turns: results stay whole and exact."""

import random

import pytest
import regex
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockprep.config import PrepConfig
from blockprep.functions.text import token_pattern
from blockprep.operators import running
from blockprep.operators.alias import alias_tables
from blockprep.operators.history import history_prompts
from blockprep.operators.messages import fold_turns, sample_keys, turn_rows
from blockprep.operators.tokens import token_ids
from tests.test_tokens import coded
from blockprep.plans import registry
from blockprep.plans.prepare import batches, corpus_vocab

CFG = PrepConfig(block_size=4, context_length=64, vocab_size=100, micro_batch=2)
PATTERN = regex.compile(token_pattern(CFG))


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(0)
    rows = []
    for conv, length in [(0, 3000), *((c, rng.randint(1, 9)) for c in range(1, 200))]:
        for turn in range(length):
            role = "user" if turn % 2 == 0 else "assistant"
            text = rng.choice(["", "a", "clear", "word " * rng.randint(1, 30)]) if turn else "start"
            rows.append((conv, turn * 7, role, text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return rows, df.repartition(11)


@pytest.fixture(autouse=True)
def short_stretches(monkeypatch):
    for function in (running.running_totals, running.running_counts_with_reset):
        monkeypatch.setattr(function, "__defaults__", (256,))


def test_ids_of_a_hot_conversation(turns):
    rows, df = turns
    messages = turn_rows(df)
    vocab = corpus_vocab(messages, CFG)
    known = {r.token: r.token_id for r in vocab.collect()}
    texts: dict = {}
    for conv, _, role, text in rows:
        texts[conv] = texts.get(conv, "") + f"<|im_start|>{role}\n{text}<|im_end|>\n"
    expected = {
        c: coded(PATTERN.findall(text), known, CFG)[: CFG.context_length]
        for c, text in texts.items()
    }
    got = {r.sample_id: r.input_ids for r in token_ids(messages, vocab, CFG).collect()}
    assert got == expected
    assert sample_keys(messages).count() == 200
    placed = batches(messages, vocab, CFG).select("batch_id", "slot").collect()
    assert sorted((r.batch_id, r.slot) for r in placed) == [(i // 2, i % 2) for i in range(200)]


def test_fold_keeps_every_message(turns):
    rows, df = turns
    pieces = fold_turns(df, piece=100).collect()
    assert max(len(p.messages) for p in pieces) == 100
    hot = sorted((p for p in pieces if p.conv_id == 0), key=lambda p: p.piece)
    assert [m.content for p in hot for m in p.messages] == [r[3] for r in rows if r[0] == 0]
    assert sum(len(p.messages) for p in pieces) == len(rows)


@pytest.mark.parametrize("width", [1, 40, 256, 10**9])
def test_history_of_a_hot_conversation(turns, monkeypatch, width):
    monkeypatch.setattr(running.running_counts_with_reset, "__defaults__", (width,))
    rows, df = turns
    expected = []
    epoch, held, current = 0, 0, None
    for conv, turn, role, text in rows:
        if conv != current:
            current, epoch, held = conv, 0, 0
        text = text.strip()
        if role == "user" and text == "clear":
            epoch, held = epoch + 1, 0
        elif role == "user" and text:
            held += 1
            expected.append((conv, turn, epoch, held, text))
        elif role != "user":
            held += 1
    assert sorted(tuple(r) for r in history_prompts(df).collect()) == sorted(expected)


def test_slots_of_views_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "TASK_VIEWS", 16, raising=False)
    made = spark.range(100).selectExpr("id AS batch_id", "0 AS view", "array_repeat(7, 64) AS input_ids")
    made.coalesce(1).write.parquet(f"{tmp_path}/views")
    stored = spark.read.parquet(f"{tmp_path}/views")
    for slots in (registry.open_slots(stored), registry.view_slots(stored)):
        ordered = slots.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("seq_id").orderBy("pos")))
        tasks = ordered.where("n > 0").groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("seq_id").alias("n")).collect()
        assert sum(t.n for t in tasks) == 100 and max(t.n for t in tasks) <= 40


def test_groups_of_alias_tables_are_dealt_to_more_tasks_than_a_shuffle_has(spark):
    probs = spark.range(4000).selectExpr("id div 4 AS g", "CAST(id % 4 AS int) AS token_id", "0.25D AS prob")
    made = alias_tables(probs, ["g"]).where("accept > 0")
    tasks = made.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("g").alias("n")).collect()
    assert sum(t.n for t in tasks) == 1000 and max(t.n for t in tasks) <= 150
