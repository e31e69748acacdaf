import math

import pandas as pd
import pytest

from blockprep.operators import scores
from tests import brute

SCHEMA = "g int, token_id int, logit double"


def table(spark, shares, group=1):
    return spark.createDataFrame([(group, t, math.log(p)) for t, p in shares.items()], SCHEMA)


def as_dict(df, value="prob"):
    return {r.token_id: getattr(r, value) for r in df.collect()}


FOUR = {10: 0.5, 11: 0.3, 12: 0.15, 13: 0.05}


@pytest.mark.parametrize(
    "top_p, kept", [(0.6, [10, 11]), (0.4, [10]), (0.5, [10, 11]), (0.8, [10, 11, 12]), (1.0, [10, 11, 12, 13])]
)
def test_nucleus(spark, top_p, kept):
    probs = scores.softmax(table(spark, FOUR), ["g"])
    got = as_dict(scores.nucleus(probs, ["g"], top_p))
    total = sum(FOUR[t] for t in kept)
    assert got == pytest.approx({t: FOUR[t] / total for t in kept})
    assert got == pytest.approx(brute.nucleus(FOUR, top_p))


def test_softmax_with_large_scores_and_temperature(spark):
    df = spark.createDataFrame([(1, 1, 1000.0), (1, 2, 1001.0), (2, 1, -5.0)], SCHEMA)
    got = scores.softmax(scores.scale(df, 0.5), ["g"]).collect()
    expected = {(1, 1): 1 / (1 + math.e**2), (1, 2): 1 / (1 + math.e**-2), (2, 1): 1.0}
    assert {(r.g, r.token_id): r.prob for r in got} == pytest.approx(expected)
    assert scores.scale(df, 0.0) is df


def test_argmax_takes_lowest_id_on_ties(spark):
    df = spark.createDataFrame([(1, 9, 2.0), (1, 4, 2.0), (1, 2, 1.0)], SCHEMA)
    assert as_dict(scores.argmax(df, ["g"]), "logit") == {4: 2.0}


def test_suppressed_best_token_renormalises(spark):
    ids = spark.createDataFrame([(10,)], "token_id int")
    probs = scores.softmax(scores.suppress(table(spark, FOUR), ids), ["g"])
    assert as_dict(probs) == pytest.approx({11: 0.6, 12: 0.3, 13: 0.1})
    everything = spark.createDataFrame([(t,) for t in FOUR], "token_id int")
    assert scores.suppress(table(spark, FOUR), everything).count() == 0


def test_draw_repeats_and_follows_shares(spark):
    groups = spark.range(3000).selectExpr("cast(id as int) as g")
    base = table(spark, FOUR).drop("g")
    probs = scores.softmax(groups.join(base), ["g"])
    first = {r.g: (r.token_id, r.prob) for r in scores.weighted_draw(probs, ["g"], 5).collect()}
    again = {r.g: (r.token_id, r.prob) for r in scores.weighted_draw(probs.repartition(3), ["g"], 5).collect()}
    assert first == again and len(first) == 3000
    for g, (token, _) in first.items():
        assert token == brute.draw(FOUR, brute.uniform(5, g))[0]
    drawn = [t for t, _ in first.values()]
    assert drawn.count(10) / 3000 == pytest.approx(0.5, abs=0.04)


def test_gather_and_scatter(spark):
    probs = scores.softmax(table(spark, FOUR), ["g"])
    kept = scores.nucleus(probs, ["g"], 0.6)
    spread = as_dict(scores.scatter(probs, kept, ["g"]))
    assert spread == pytest.approx({10: 0.625, 11: 0.375, 12: 0.0, 13: 0.0})
    chosen = scores.argmax(probs, ["g"])
    assert as_dict(scores.gather(probs, chosen, ["g"])) == pytest.approx({10: 0.5})


def test_shift(spark):
    df = spark.createDataFrame([(s, i, 10 * s + i) for s in (1, 2) for i in range(4)], "seq_id int, pos int, x int")
    got = {(r.seq_id, r.pos): r.x for r in scores.shift_scores(df.repartition(3), ["x"]).collect()}
    assert [got[1, i] for i in range(4)] == [10, 10, 11, 12]
    assert [got[2, i] for i in range(4)] == [20, 20, 21, 22]


def test_confident_or_best(spark):
    rows = [
        # all below the threshold: only the best
        (1, 0, 0, True, 0.2),
        (1, 0, 1, True, 0.5),
        (1, 0, 2, True, 0.5),
        # equal to the threshold is not confident; filled slots never count
        (1, 1, 3, True, 0.9),
        (1, 1, 4, True, 0.95),
        (1, 1, 5, False, 0.99),
        # nothing masked
        (2, 0, 0, False, 0.99),
        # a slot without a score may still be the only one
        (3, 0, 0, True, None),
    ]
    df = spark.createDataFrame(rows, "seq_id int, sub_block int, pos int, masked boolean, prob double")
    got = {(r.seq_id, r.pos) for r in scores.select_confident(df, 0.9).where("chosen").collect()}
    assert got == {(1, 1), (1, 4), (3, 0)}
    everything = {(r.seq_id, r.pos) for r in scores.select_confident(df, 1.0).where("chosen").collect()}
    assert everything == {(1, 1), (1, 4), (3, 0)}


def test_context_counts_and_model_hook(spark):
    pairs = spark.createDataFrame([(0, 7)] * 5 + [(0, 8), (3, 7)], "ctx int, label int")
    counts = scores.context_counts(pairs)
    assert {(r.ctx, r.label, r.n) for r in counts.collect()} == {(0, 7, 5), (0, 8, 1), (3, 7, 1)}
    overall = scores.softmax(scores.overall_scores(counts), ["ctx"])
    assert as_dict(overall) == pytest.approx({7: 6 / 7, 8: 1 / 7})

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(token_id=batch["ctx"] + 1, logit=0.5)[["ctx", "token_id", "logit"]]

    scored = scores.score_with(counts.select("ctx").distinct(), model, "ctx int, token_id int, logit double")
    assert {(r.ctx, r.token_id) for r in scored.collect()} == {(0, 1), (3, 4)}
