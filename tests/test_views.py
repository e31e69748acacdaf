import hashlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from blockprep.config import IGNORE_LABEL, PrepConfig
from blockprep.functions.arrays import additive_value, block_of, prefix_visible_upto, visible_upto
from blockprep.operators.packing import assign_batches, pack, pack_offsets, step_plan
from blockprep.operators.views import (
    attach_visibility,
    batch_profile,
    complementary_views,
    flatten_views,
    training_pairs,
    view_positions,
)
from tests import brute

CFG = PrepConfig(block_size=4, context_length=8, micro_batch=1)
IDS = "sample_id long, input_ids array<int>, batch_id long, slot int"


def packed(spark, rows, cfg):
    return {r.batch_id: r.input_ids for r in pack(spark.createDataFrame(rows, IDS), cfg).collect()}


def test_packing_rules(spark):
    rows = [
        (1, [], 1, 0),
        (2, [5, 6, 7, 1], 2, 0),
        (3, [9] * 9, 3, 0),
        (4, [5, 0, 6, 1], 4, 0),
    ]
    assert packed(spark, rows, CFG) == {
        1: [0] * 8,
        2: [5, 6, 7, 1, 0, 0, 0, 0],
        3: [9] * 8,
        4: [5, 0, 6, 1, 0, 0, 0, 0],
    }
    two = replace(CFG, micro_batch=2)
    rows = [(1, [2, 3, 4, 5, 1], 1, 1), (2, [6, 7, 8, 9, 1], 1, 0), (3, [6, 1], 2, 0), (4, [7, 1], 2, 1)]
    assert packed(spark, rows, two) == {1: [6, 7, 8, 9, 1, 0, 0, 0], 2: [6, 1, 0, 0, 7, 1, 0, 0]}
    free = replace(two, pad_to_context=False)
    assert len(packed(spark, rows, free)[1]) == 16
    offsets = pack_offsets(spark.createDataFrame(rows, IDS), two).orderBy("batch_id", "slot").collect()
    assert [(r.padded_len, r.offset) for r in offsets] == [(8, 0), (8, 8), (4, 0), (4, 4)]


def brute_coin(cfg, epoch, batch, pos):
    digest = hashlib.md5(f"{cfg.seed}:{epoch}:{batch}:{pos // 32}".encode()).hexdigest()
    return int(digest[:8], 16) >> (pos % 32) & 1


@pytest.fixture(scope="module")
def contexts(spark):
    rows = [(b, [(b * 7 + i) % 11 for i in range(70)]) for b in range(12)] + [(99, [])]
    return rows, spark.createDataFrame(rows, "batch_id long, input_ids array<int>")


@pytest.mark.parametrize("epoch", [0, 3])
def test_views_against_brute_force(contexts, epoch):
    rows, df = contexts
    expected = {}
    for b, ids in rows:
        for view in (0, 1):
            hidden = [t != 0 and brute_coin(CFG, epoch, b, i) == 1 - view for i, t in enumerate(ids)]
            expected[b, view] = (
                [0 if h else t for h, t in zip(hidden, ids)],
                [t if h else IGNORE_LABEL for h, t in zip(hidden, ids)],
            )
    for parts in (1, 6):
        got = complementary_views(df.repartition(parts), CFG, epoch).collect()
        assert {(r.batch_id, r.view): (r.input_ids, r.labels) for r in got} == expected


def test_every_valid_position_is_labelled_once(contexts):
    rows, df = contexts
    long = view_positions(complementary_views(df, CFG)).where(F.col("label") != IGNORE_LABEL)
    got = sorted((r.batch_id, r.pos, r.label) for r in long.collect())
    assert got == sorted((b, i, t) for b, ids in rows for i, t in enumerate(ids) if t != 0)


def test_training_pairs(contexts):
    _, df = contexts
    views = complementary_views(df, CFG)
    expected = sorted(
        (r.batch_id, r.view, i, r.input_ids[i - 1], r.labels[i])
        for r in views.collect()
        for i in range(1, len(r.labels))
        if r.labels[i] != IGNORE_LABEL
    )
    assert sorted(tuple(r) for r in training_pairs(views).collect()) == expected


def test_profile_and_flatten(contexts):
    _, df = contexts
    views = complementary_views(df, CFG)
    for r in batch_profile(views, CFG).collect():
        assert r.positions == r.labelled + r.visible + r.padding
    stacked = views.groupBy("batch_id").agg(F.collect_list("labels").alias("x"))
    flat = flatten_views(stacked, ["batch_id"], "x")
    assert flat.count() == views.count()
    assert sorted({r.view for r in flat.collect()}) == [0, 1]


def test_visibility_matches_pair_rule(spark):
    length, block = 10, 4
    pos = spark.range(length).select(F.col("id").cast("int").alias("q"))
    got = pos.select(
        "q",
        visible_upto("q", length, block).alias("v"),
        prefix_visible_upto("q", length, block).alias("p"),
        block_of("q", block).alias("b"),
    ).collect()
    for r in got:
        assert r.b == r.q // block
        assert [k < r.v for k in range(length)] == [k // block <= r.q // block for k in range(length)]
        start = length - block
        assert [k < r.p for k in range(length)] == [
            k <= r.q or (r.q >= start and k >= start) for k in range(length)
        ]
    values = pos.select(additive_value("q", F.lit(4)).alias("x")).collect()
    assert [r.x for r in values] == [0.0] * 4 + [-65504.0] * 6


def test_attached_visibility_sum(contexts):
    _, df = contexts
    cfg = replace(CFG, context_length=70)
    seen = attach_visibility(complementary_views(df, cfg), cfg).where("batch_id = 0 and view = 0").first()
    assert sum(seen.visible_upto) == sum(min(70, (q // 4 + 1) * 4) for q in range(70))


def order_key(cfg, epoch, sample):
    return hashlib.md5(f"{cfg.seed}:{epoch}:{sample}".encode()).hexdigest(), sample


def test_batches_follow_one_global_order(spark):
    cfg = replace(CFG, micro_batch=3)
    df = spark.range(100).select(F.col("id").alias("sample_id"))
    order = sorted(range(100), key=lambda s: order_key(cfg, 2, s))
    expected = {s: (i // 3, i % 3) for i, s in enumerate(order)}
    for parts in (1, 9):
        for population in (None, df):
            got = assign_batches(df.repartition(parts), cfg, 2, population).collect()
            assert {r.sample_id: (r.batch_id, r.slot) for r in got} == expected


def test_step_plan(spark):
    cfg = replace(CFG, micro_batch=2)
    df = spark.range(7).select(F.col("id").alias("sample_id"))
    expected = []
    micro = 0
    numbers = {s: i for i, s in enumerate(sorted(range(7), key=lambda s: order_key(cfg, "index", s)))}
    for epoch in range(3):
        order = sorted(range(7), key=lambda s: brute.permuted(numbers[s], 7, cfg.seed, epoch))
        for start in range(0, 7, 2):
            for slot, s in enumerate(order[start : start + 2]):
                expected.append((micro // 3, micro, epoch, slot, s))
            micro += 1
    expected = sorted(e for e in expected if e[1] < 9)
    got = step_plan(df, cfg, max_steps=3, accumulation=3)
    assert sorted(tuple(r) for r in got.collect()) == expected
    assert step_plan(df, cfg, 0, 3).count() == 0
