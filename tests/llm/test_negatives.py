import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockprep.llm import negatives


def brute(rows, positives=5, k=10, least=30, most=90, scale=256):
    usable = []
    for row, (i, v, label) in enumerate(rows):
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(x * scale) for x in v]
        if all(abs(x * scale) < 2**31 for x in v) and sum(x * x for x in whole) < 2**62:
            usable.append((i, row, whole, label))
    out = []
    for a, arow, av, alabel in usable:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), i, label) for i, _, v, label in usable if i != a and len(v) == len(av)]
        scored.sort()
        for p, (ps, pid, _) in enumerate([s for s in scored if s[2] == alabel][:positives]):
            fits = [s for s in scored if s[2] != alabel and least * -ps <= 100 * -s[0] <= most * -ps]
            out += [(a, pid, r, i, -ps, -s) for r, (s, i, _) in enumerate(fits[:k], 1)]
    return sorted(out)


def check(spark, rows, **settings):
    df = spark.createDataFrame(
        [(*r, "x", "y", "z") for r in rows], "vec_id long, embedding array<double>, label int, tile string, d string, `a.b` string"
    ).repartition(5)
    found = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **settings)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in found.collect())
    assert got == brute(rows)
    return got


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(negatives, "TILE", 100)
    monkeypatch.setattr(negatives, "LEAST_TILE", 20)
    monkeypatch.setattr(negatives, "BLOCK", 8)


def clustered(rng, n, d, labels=4):
    centres = rng.normal(size=(labels, d))
    return [(i, (centres[i % labels] * 0.6 + rng.normal(size=d) * 0.5).tolist(), int(rng.integers(labels))) for i in range(n)]


def test_clustered_vectors(spark):
    assert check(spark, clustered(np.random.default_rng(1), 700, 6))


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 400, 3)
    # Equal vectors, zero vectors, other lengths, a rare label, shared ids, whole rows repeated.
    rows += [(i, [0.5, 0.25, 0.125], i % 2) for i in range(400, 520)]
    rows += [(500, [0.1, 0.2, 0.3], 1), (7, [0.4, 0.4, 0.4], 0), (7, [0.4, 0.4, 0.4], 0), (600, [0.0, 0.0, 0.0], 0)]
    rows += [(700 + i, rng.normal(size=2).tolist(), i % 3) for i in range(30)]
    rows += [(800, [1.0], 9), (900, [1.0, 1.0, 1.0], 77)]
    rows += [(901, None, 1), (902, [], 1), (903, [1.0, None, 1.0], 1), (904, [math.nan, 1.0, 1.0], 1), (905, [math.inf, 1.0, 1.0], 1)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (1000, [1.0, 1.0, 1.0], None), (1100, [1e300, 1.0, 1.0], 1), (1200, [-8e6, 8e6, 8e6], 1)]
    check(spark, rows)


def test_scores_beyond_exact_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 10, (rng.normal(size=4) * 1e6 + 2e6).tolist(), i % 3) for i in range(200)]
    found = check(spark, rows)
    assert max(r[4] for r in found) > 2**53


def test_anchors_go_to_every_tile_without_ranges(spark, monkeypatch):
    monkeypatch.setattr(negatives, "MAX_RANGES", 1)
    check(spark, clustered(np.random.default_rng(4), 300, 4))


def test_no_rows(spark):
    check(spark, [(100, [1.0, 2.0], None)])
    check(spark, [(100, [1.0, 2.0], 1)])


def test_intervals_hold_and_leave_rows_unscored():
    rng = np.random.default_rng(5)
    v = np.floor(256 * (np.repeat(rng.normal(size=(8, 16)), 100, axis=0) + rng.normal(size=(800, 16)) * 0.2)).astype(np.int32)
    units = negatives._units(v[rng.integers(800, size=16)].astype(float))
    angles, norms = negatives.angles_to(units, v.astype(float))
    rows = negatives.Rows(np.arange(800), np.arange(800), np.arange(800) // 100, v, angles, norms)
    scored = 0
    for i in range(0, 800, 40):
        scores = v.astype(np.int64) @ v[i].astype(np.int64)
        lower, upper = rows._interval(np.arange(800), angles[i].astype(float), norms[i])
        assert (lower <= scores).all() and (scores <= upper).all()
        least = int(np.sort(scores)[-50])
        scored += (upper >= least).sum()
    assert scored < 20 * 800 * 0.5
