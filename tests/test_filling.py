import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from blockprep.config import PrepConfig
from blockprep.operators import filling
from blockprep.operators.tokens import detokenize
from blockprep.operators.vocabulary import special_tokens
from blockprep.streaming.ingest import tail_state_log
from tests import brute

CFG = PrepConfig(block_size=6, sub_block_size=4, max_new_tokens=10, threshold=0.4, top_p=0.9)
SUPPRESSED = [0, 3, 4]


def score_rows(seed=1, size=14):
    """Integer-count scores over ids 1..size, the mask id being a context too."""
    rng = random.Random(seed)
    rows = []
    for ctx in [-1, 0, *range(5, size)]:
        for token in rng.sample(range(0, size), 6):
            rows.append((ctx, token, math.log(rng.randint(1, 9))))
        if ctx == -1:
            rows.append((ctx, 13, math.log(20)))
    return list({(c, t): (c, t, x) for c, t, x in rows}.values())


def inputs(spark, rows):
    scores = spark.createDataFrame(rows, "ctx int, token_id int, logit double")
    suppressed = spark.createDataFrame([(i,) for i in SUPPRESSED], "token_id int")
    lasts = {s: 5 + s % 11 for s in range(30)}
    lasts[30] = 0
    prompts = spark.createDataFrame(
        [(s, [9, t] if t else []) for s, t in lasts.items()], "seq_id long, input_ids array<int>"
    )
    return prompts, scores, suppressed, lasts


def collected(filled):
    out = {}
    for r in filled.orderBy("seq_id", "pos").collect():
        tokens, steps = out.setdefault(r.seq_id, ([], []))
        assert r.pos == len(tokens)
        tokens.append(r.token_id)
        steps.append(r.step)
    return out


@pytest.mark.parametrize("temperature, limit", [(0.0, None), (0.8, None), (0.8, 0)])
def test_fill_against_brute_force(spark, monkeypatch, temperature, limit):
    if limit is not None:  # force the shuffled lookup
        monkeypatch.setattr(filling, "BROADCAST_ROWS", limit)
    cfg = replace(CFG, temperature=temperature)
    rows = score_rows()
    prompts, scores, suppressed, lasts = inputs(spark, rows)
    expected = brute.fill(lasts, rows, SUPPRESSED, cfg)
    got = collected(filling.fill(prompts, scores, suppressed, cfg))
    assert got == expected
    lengths = {len(tokens) for tokens, _ in expected.values()}
    assert temperature == 0 or len(lengths) > 1  # some stop early, others go on


def test_fill_is_the_same_on_any_partitioning(spark):
    cfg = replace(CFG, temperature=0.8, max_new_tokens=6)
    prompts, scores, suppressed, _ = inputs(spark, score_rows(3))
    one = collected(filling.fill(prompts.repartition(1), scores, suppressed, cfg))
    many = collected(filling.fill(prompts.repartition(9), scores.repartition(5), suppressed, cfg))
    assert one == many


def test_log_and_states(spark, tmp_path):
    cfg = replace(CFG, max_new_tokens=6)
    prompts, scores, suppressed, _ = inputs(spark, score_rows())
    log = str(tmp_path / "log")
    filled = filling.fill(prompts, scores, suppressed, cfg, log=log)
    logged = {tuple(r) for r in filling.state_log(filled).collect()}
    query = (
        tail_state_log(spark, log).writeStream.format("memory").queryName("tail")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    tailed = {tuple(r) for r in spark.table("tail").select("seq_id", "step", "pos", "token_id").collect()}
    assert logged <= tailed  # the log also holds what the final trim cut off
    last = filled.agg(F.max("step")).first()[0]
    before = None
    for step in range(last + 1):
        open_slots = filling.state_at(filled, step, cfg).where("token_id = 0").count()
        assert before is None or open_slots <= before
        before = open_slots
    assert before == 0


def test_nothing_to_fill(spark):
    prompts, scores, suppressed, _ = inputs(spark, score_rows())
    assert filling.fill(prompts, scores, suppressed, replace(CFG, max_new_tokens=0)).count() == 0
    assert filling.fill(prompts.limit(0), scores, suppressed, CFG).count() == 0
    with pytest.raises(ValueError):
        filling.fill(prompts, scores.where("ctx >= 0"), suppressed, CFG)


SLOTS = "seq_id int, pos int, token_id int"


def test_complete_eos_and_trim(spark):
    data = {1: [5, 0, 1, 1], 2: [5, 6, 1, 0, 1], 3: [5, 6], 4: [1], 5: [0, 1]}
    df = spark.createDataFrame([(s, i, t) for s, x in data.items() for i, t in enumerate(x)], SLOTS)
    assert {r.seq_id: r.eos_pos for r in filling.complete_eos(df, CFG).collect()} == {2: 2, 4: 0}
    kept = {}
    for r in filling.trim_at_eos(df, CFG).collect():
        kept[r.seq_id] = kept.get(r.seq_id, 0) + 1
    assert kept == {1: 4, 2: 3, 3: 2, 4: 1, 5: 2}
    assert {r.seq_id: r.has_mask for r in filling.has_mask(df, CFG).collect()} == {
        1: True, 2: True, 3: False, 4: False, 5: True
    }


def test_guard_write_back_and_display(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 0), (1, 2, 1), (1, 3, 0)], SLOTS)
    guarded = filling.fill_leftovers(df.withColumn("finished", F.lit(False)), CFG).orderBy("pos")
    assert [r.token_id for r in guarded.collect()] == [5, 1, 1, 1]
    padded = replace(CFG, eos_id=None, pad_id=7)
    guarded = filling.fill_leftovers(df.withColumn("finished", F.lit(False)), padded).orderBy("pos")
    assert [r.token_id for r in guarded.collect()] == [5, 7, 1, 7]
    fills = spark.createDataFrame([(1, 1, 9)], SLOTS)
    assert [r.token_id for r in filling.apply_fills(df, fills).orderBy("pos").collect()] == [5, 9, 1, 0]
    vocab = special_tokens(spark).unionByName(
        spark.createDataFrame([("a", 5, False)], "token string, token_id int, is_special boolean")
    )
    shown = filling.slot_score(filling.render_state(df, vocab, CFG), CFG).orderBy("pos").collect()
    assert [(r.shown, r.score) for r in shown] == [("a", -0.5), ("[MASK]", 0.5), ("", -0.5), ("[MASK]", 0.5)]
    lengths = spark.createDataFrame([(1, 2)], "seq_id int, prompt_len int")
    assert filling.response_only(df, lengths).count() == 2
    text = detokenize(filling.sequence_ids(df), vocab, CFG, ["seq_id"]).first().text
    assert text == "a"
