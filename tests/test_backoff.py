import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockprep.config import PrepConfig
from blockprep.functions.hashing import uniform
from blockprep.operators import alias, backoff, filling, packed, scores, views
from blockprep.operators.backoff import Automaton, Backoff
from tests import brute

CFG = PrepConfig(block_size=6, sub_block_size=4, max_new_tokens=14, threshold=0.4, top_p=0.9, context_length=48)
SIDES = (-1, -2, 1)


def stored_views(spark, seed=1, n=40):
    rng = random.Random(seed)
    rows = []
    for b in range(n):
        at, ids = rng.randrange(5, 14), []
        for _ in range(CFG.context_length):
            at = 5 + (at * 3 + rng.choice([0, 1, 1, 2])) % 9 if rng.random() < 0.9 else 1
            ids.append(at)
        rows.append((b, ids[: rng.randrange(20, 48)]))
    contexts = spark.createDataFrame(rows, "batch_id long, input_ids array<int>")
    return views.complementary_views(contexts, CFG)


def setting(spark, seed=1):
    stored = stored_views(spark, seed).cache()
    suppressed = spark.createDataFrame([(0,), (3,), (4,)], "token_id int")
    prompts = spark.createDataFrame(
        [(s, [5 + (s * k) % 9 for k in range(s % 4)]) for s in range(60)], "seq_id long, input_ids array<int>"
    )
    return stored, suppressed, prompts


def rows(df):
    return sorted(tuple(r) for r in df.select("seq_id", "pos", "token_id", "step").collect())


def test_contexts_see_what_the_query_sees(spark):
    stored = stored_views(spark, n=3)
    got = Counter((r.batch_id, r.view, r.pos, r.label, r.depth, tuple(r.ctx)) for r in backoff.context_rows(stored, CFG, SIDES).collect())
    expected = Counter()
    for r in stored.collect():
        x = r.input_ids
        for pos, label in enumerate(r.labels):
            if pos < 1 or label == -100:
                continue
            head = (r.batch_id, r.view, pos, label)
            expected[*head, 0, ()] += 1
            expected[*head, 1, (x[pos - 1],)] += 1
            if pos >= 2:
                expected[*head, 2, (x[pos - 1], x[pos - 2])] += 1
                query_block_end = min(((pos - 1) // CFG.block_size + 1) * CFG.block_size, len(x))
                if pos + 1 < query_block_end:
                    expected[*head, 3, (x[pos - 1], x[pos - 2], x[pos + 1])] += 1
    assert got == expected


@pytest.mark.parametrize("temperature", [0.0, 0.8])
def test_order_one_is_the_score_table(spark, temperature):
    cfg = replace(CFG, temperature=temperature)
    stored, suppressed, prompts = setting(spark)
    counts = scores.context_counts(views.training_pairs(stored))
    table = scores.context_scores(counts).unionByName(scores.overall_scores(counts))
    one = rows(filling.fill(prompts, table, suppressed, cfg))
    assert one == rows(filling.fill(prompts, None, suppressed, cfg, scorer=Backoff.fit(stored, cfg)))
    assert one != rows(filling.fill(prompts, None, suppressed, cfg, scorer=Backoff.fit(stored, cfg, SIDES)))


@pytest.mark.parametrize("temperature, path", [(0.0, SIDES), (0.8, SIDES), (0.0, (1, -1)), (0.8, ())])
def test_rows_and_packed_blocks_agree(spark, monkeypatch, temperature, path):
    cfg = replace(CFG, temperature=temperature)
    stored, suppressed, prompts = setting(spark, 2)
    scorer = Backoff.fit(stored, cfg, path)
    packed_rows = rows(filling.fill(prompts, None, suppressed, cfg, scorer=scorer))
    assert len({r[0] for r in packed_rows}) == 60
    monkeypatch.setattr(filling, "BROADCAST_ROWS", 0)
    assert rows(filling.fill(prompts, None, suppressed, cfg, scorer=scorer)) == packed_rows


def test_a_model_that_asks_the_table_fills_like_it(spark):
    stored, suppressed, prompts = setting(spark, 3)
    scorer = Backoff.fit(stored, CFG, SIDES)
    table = {}
    for r in scorer.table.collect():
        table.setdefault(tuple(r.ctx), {})[r.token_id] = r.logit
    table = {c: x for c, x in table.items() if set(x) - {0, 3, 4}}

    def model(tokens, query, upto):
        slot = upto if upto < len(tokens) else query + 1
        at = lambda i: int(tokens[i]) if 0 <= i < len(tokens) else 0
        near = [at(slot - 1), at(slot - 2)] + ([at(slot + 1)] if slot + 1 < upto else [])
        found = next(x for x in (table.get(tuple(near[:d])) for d in range(len(near), -1, -1)) if x)
        return list(found), list(found.values())

    by_table = rows(filling.fill(prompts.where("size(input_ids) > 0"), None, suppressed, CFG, scorer=scorer))
    assert rows(filling.fill(prompts.where("size(input_ids) > 0"), None, suppressed, CFG, scorer=model)) == by_table


def test_sampling_by_a_model_follows_its_shares():
    shares = {5: 0.5, 6: 0.25, 7: 0.15, 8: 0.1}
    model = packed.FromModel(lambda *_: (list(shares) + [0], [np.log(p) for p in shares.values()] + [9.0]), [0], replace(CFG, temperature=1.0, top_p=0.8))
    n = 4000
    u = (np.arange(n) + 0.5) / n
    tokens, probs = model.propose([np.array([5])], np.zeros((1, 6), np.int64), np.zeros(n, int), np.ones(n, int), lambda: u)
    found = Counter(tokens.tolist())
    assert {t: x / n for t, x in found.items()} == pytest.approx({t: p / 0.9 for t, p in shares.items() if t < 8}, abs=1e-3)
    assert set(np.round(probs, 6)) == {round(p / 0.9, 6) for t, p in shares.items() if t < 8}


def test_a_pass_moves_no_row_with_adaptive_execution(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    stored, suppressed, prompts = setting(spark, 4)
    candidates = filling.prepare_candidates(Backoff.fit(stored, CFG, SIDES), suppressed, CFG)
    automaton = Automaton(candidates.table.orderBy("depth", "ctx", "cell").toArrow(), SIDES)
    table = packed.FromTable(automaton, CFG)
    proposer = lambda: table
    state = prompts.select("seq_id", F.col("input_ids").alias("seen"))
    block = packed.fill_block(state, 6, 0, 0, CFG, proposer, 2)
    again = packed.fill_block(block.where("eos IS NULL"), 6, 6, 8, CFG, proposer, 2)
    plan = packed.block_slots(again, 6)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    assert packed.block_slots(again, 6).count() > 0


def test_filled_slots_and_finished_sequences_are_not_asked():
    asked = []

    class Known:
        def propose(self, seen, blocks, rows, slots, u):
            asked.append((rows.tolist(), slots.tolist()))
            tokens = np.where((rows == 0) & (slots == 1), CFG.eos_id, 7)
            return tokens, np.where(slots % 2 == 0, 0.9, 0.1)

    ids, steps, ends, passes = packed.fill_matrix([np.array([5])] * 2, [0, 1], 6, 0, 0, CFG, Known())
    assert ends.tolist() == [1, -1] and ids[0].tolist()[:2] == [7, 1] and ids[1].tolist() == [7] * 6
    for rows_, slots in asked:
        assert len(set(zip(rows_, slots))) == len(rows_)
    # Row 0 ends in the second pass; nobody asks about it, or about a filled slot, after that.
    assert all(0 not in r for r, _ in asked[4:])
    assert steps[1].tolist() == [0, 2, 0, 4, 1, 3] and passes.tolist() == [2, 3]


def test_guard_and_odd_settings():
    class Never:
        def propose(self, seen, blocks, rows, slots, u):
            return np.full(len(rows), CFG.mask_id), np.zeros(len(rows))

    ids, steps, ends, _ = packed.fill_matrix([np.array([], int)], ["a"], 3, 0, 0, CFG, Never())
    assert ids.tolist() == [[1, 1, 1]] and ends.tolist() == [0]
    ids, _, ends, _ = packed.fill_matrix([np.array([], int)], ["a"], 3, 0, 0, replace(CFG, eos_id=None, pad_id=7), Never())
    assert ids.tolist() == [[7, 7, 7]] and ends.tolist() == [-1]


def shares_of(rows_):
    out = Counter()
    for r in rows_:
        out[r.token_id] += r.accept / r.size
        out[r.alias_id] += (1 - r.accept) / r.size
    return out


def test_alias_cells_add_up_to_the_shares(spark):
    rng = random.Random(5)
    groups = {}
    for g in range(60):
        weights = [rng.choice([1, 1, 2, 3, 50, 400]) for _ in range(rng.randrange(1, 40))]
        groups[g] = {t: w / sum(weights) for t, w in zip(rng.sample(range(100), len(weights)), weights)}
    df = spark.createDataFrame([(g, t, p) for g, x in groups.items() for t, p in x.items()], "g int, token_id int, prob double")
    made = alias.alias_tables(df.repartition(7), ["g"]).collect()
    assert len(made) == sum(map(len, groups.values()))
    for g, probs in groups.items():
        own = sorted((r for r in made if r.g == g), key=lambda r: r.cell)
        assert [r.cell for r in own] == list(range(len(probs)))
        assert [(r.token_id, pytest.approx(r.accept, abs=1e-9), r.alias_id) for r in own if r.accept < 1] == [
            c for c in brute.alias_cells(probs) if c[1] < 1
        ]
        found = shares_of(own)
        assert all(found[t] == pytest.approx(p, abs=1e-9) for t, p in probs.items())
        assert all(r.alias_prob == pytest.approx(probs[r.alias_id]) for r in own)


def test_draws_follow_the_shares(spark):
    """Chi-square of 20,000 draws against 5 shares, four degrees of freedom."""
    weights = {5: 1, 6: 2, 7: 10, 8: 4, 9: 3}
    table = spark.createDataFrame([(0, [], t, float(np.log(w))) for t, w in weights.items()], "depth int, ctx array<int>, token_id int, logit double")
    cfg = replace(CFG, temperature=1.0, top_p=1.0)
    candidates = filling.prepare_candidates(Backoff(table, ()), spark.createDataFrame([(0,)], "token_id int"), cfg)
    assert candidates.table.count() == len(weights)
    slots = spark.range(20_000).selectExpr("id AS seq_id", "0 AS pos", "0 AS token_id", "array(5) AS seen")
    drawn = filling.add_candidates(slots, candidates, cfg, 3)
    found = {r.candidate: r["count"] for r in drawn.groupBy("candidate").count().collect()}
    expected = {t: 20_000 * w / 20 for t, w in weights.items()}
    assert sum((found[t] - e) ** 2 / e for t, e in expected.items()) < 18.5  # p = 0.001
    automaton = Automaton(candidates.table.orderBy("depth", "ctx", "cell").toArrow(), ())
    u = np.array([r.u for r in slots.select("seq_id", uniform(cfg.seed, 3, F.col("seq_id"), F.col("pos")).alias("u")).orderBy("seq_id").collect()])
    tokens, _ = automaton.draw(np.zeros(len(u), np.int64), u)
    assert Counter(tokens.tolist()) == found
