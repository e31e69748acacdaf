import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from blockprep.llm import decontaminate, linededup, lm, sharding, toxicity
from blockprep.llm.common import utf8
from tests.llm.odd import empty, odd_documents

LOWER = {c: c + 32 for c in range(65, 91)}


def test_shards_are_even_gapless_and_repeatable(spark):
    docs = odd_documents(spark, "shard string, slot string, note string")
    rows = sharding.shard_documents(docs, shards=4).collect()
    assert len(rows) == docs.count() and all(r["note"] == "x" for r in rows)
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == {0, 1, 2, 3}
    for shard in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sizes[shard]))
    again = sharding.shard_documents(docs.repartition(7), shards=4).collect()
    key = lambda r: (r["shard"], r["slot"], r["doc_id"] or -1)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    few = sharding.shard_documents(docs.limit(3), shards=16).collect()
    assert sorted(r["shard"] for r in few) == [0, 1, 2] and {r["slot"] for r in few} == {0}
    assert sharding.shard_documents(empty(docs)).count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    docs = odd_documents(spark)
    sharding.write_shards(sharding.shard_documents(docs, shards=3), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 3


def test_fisher_yates_is_a_permutation_and_uniform():
    assert sorted(sharding.fisher_yates(50, [1, 2])) == list(range(50))
    seen = Counter(tuple(sharding.fisher_yates(3, [s])) for s in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items):
    words = WORD.findall((text or "").translate(LOWER).encode())
    hit, ids = [False] * len(words), set()
    for item, body in items:
        own = WORD.findall((body or "").translate(LOWER).encode())
        n = min(10, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    hit[i : i + n] = [True] * n
                    ids |= {str(item)} if item is not None else set()
    return len(words), sum(hit), sorted(ids)


@pytest.mark.parametrize("part_bytes", [1 << 20, 40])
def test_contamination_equals_brute_force(spark, part_bytes):
    docs = odd_documents(spark, "n_hit string").where("doc_id IS NULL OR doc_id <> 12")
    body = docs.where("doc_id = 1").first()["text"].split()
    items = [(1, " ".join(body[5:20])), (2, "one two"), (3, ""), (4, None), (None, " ".join(body[30:45])), (5, "IT'S x"), (1, "tail")]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.mark_contamination(docs, table, part_bytes=part_bytes).collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert (row["n_words"], row["n_hit"], row["hit_items"]) == contamination(row["text"], items)
        covered = " ".join((row["text"] or "")[s["start"] : s["end"]] for s in row["hit_spans"])
        assert len(WORD.findall(covered.translate(LOWER).encode())) == row["n_hit"]
    assert decontaminate.mark_contamination(empty(docs), table).count() == 0
    assert decontaminate.mark_contamination(docs, empty(table)).where("n_hit > 0").count() == 0


def line_dedup(rows, least=50):
    """The operator's rule by brute force: every line against every earlier one; documents in order."""
    lines = [[re.sub("\r$", "", x).strip(" ") for x in text.split("\n")] for _, text in rows]
    size = [[max(1, len(re.findall(r"[^ \t\n\x0b\f\r]+", x))) for x in own] for own in lines]
    out = {}
    for d, (doc, text) in enumerate(rows):
        gone = set()
        for s in range(d + 1):
            for i in range(len(lines[d])):
                for q in range(len(lines[s]) if s < d else i):
                    if i and q and lines[d][i - 1] == lines[s][q - 1]:
                        continue
                    n = 0
                    while i + n < len(lines[d]) and q + n < len(lines[s]) and lines[d][i + n] == lines[s][q + n]:
                        n += 1
                    if sum(size[d][i : i + n]) >= least:
                        gone |= set(range(i, i + n))
        out[doc] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), len(gone)
    return out


def test_line_dedup_equals_its_rule(spark):
    docs = odd_documents(spark, "n_lines string, _runs string, note string")
    rows = linededup.dedup_lines(docs).collect()
    assert len(rows) == docs.count() and {r["note"] for r in rows} == {"x"}
    known = {(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None}
    expected = line_dedup(sorted(known, key=lambda r: (r[0] is None, r[0] or 0)))
    for row in rows:
        if row["n_lines"]:
            assert (row["text"], row["n_removed"]) == expected[row["doc_id"]], row["doc_id"]
        else:
            assert row["text"] is None and row["n_removed"] == 0
    by_id = {r["doc_id"]: r["text"] for r in rows}
    assert by_id[2] == "" and by_id[5] == "other\nend" and by_id[14] == "same line of five words"
    assert linededup.dedup_lines(empty(docs)).count() == 0


def test_line_dedup_extends_both_ways(spark):
    long, a, b, c = " ".join(f"z{i}" for i in range(55)), "short one", "short two", "short three"
    docs = spark.createDataFrame([(1, "\n".join([a, b, long, c])), (2, "\n".join(["x", b, long, c, "y"])), (3, "\n".join([b, c]))], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: "\n".join([a, b, long, c]), 2: "x\ny", 3: "\n".join([b, c])}
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_line_dedup_takes_runs_from_several_places(spark):
    word = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    r, s, u = word("r", 60), word("s", 40), word("u", 9)
    rows = [(1, f"{r}\nfirst"), (2, f"{r}\n{s}\nsecond"), (3, f"{r}\n{s}\nthird"), (4, f"{s}\n{u}\nfourth"), (5, f"{u}\n{s}\n{u}\nfifth")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: f"{s}\nsecond", 3: "third", 4: rows[3][1], 5: rows[4][1]}


def test_line_dedup_of_random_lines_with_few_broadcast_keys(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 2)
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 5, 9]))) for _ in range(12)]
    rows = [(d, "\n".join(rng.choice(pool[: rng.choice([2, 4, 12])]) for _ in range(rng.randrange(60)))) for d in range(60)]
    for k in range(3, 40, 4):
        rows[k] = (k, rows[k][1] + "\n" + rows[k - 2][1] + "\nnew " + str(k))
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    expected = line_dedup(rows, 20)
    assert sum(n > 0 for _, n in expected.values()) > 20
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got} == expected


def test_line_dedup_of_a_text_longer_than_a_piece(spark):
    own = "\n".join(f"line {i} " + "x" * 60 for i in range(45_000))
    rows = [(1, own), (2, "before\n" + own[: 1 << 21])]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"].count("\n") <= 1 and got[2]["n_removed"] > 25_000


def language_model(rows, share=lm.SHARE):
    tokens = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]) for d, t in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    words, pairs = Counter(), Counter()
    for d, w in tokens:
        if not held(d):
            words.update(w)
            pairs.update(zip([None] + w[:-1], w))
    n, v = sum(words.values()), len(words)
    once, twice = (sum(c == k for c in words.values()) for k in (1, 2))
    off = once / (once + 2 * twice) if once and twice else 0.5
    out = []
    for d, w in tokens:
        state, score = None, 0.0
        for x in w:
            root = ((words[x] - off) / n if words[x] else off * v / n) if n else 1.0
            take = share * words[state] / (words[state] + 1)
            seen = take * pairs[state, x] / words[state] if pairs[state, x] else 0.0
            score += math.log10(seen + (1 - take) * root)
            state = x
        base = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((d, held(d), len(w), sum(words[x] > 0 for x in w), n, base, score))
    return out


def test_language_model_equals_a_walk_word_by_word(spark):
    docs = odd_documents(spark, "score string, block string")
    rows = [tuple(r) for r in lm.score_documents(docs, block_bytes=20_000).collect()]
    order = lambda r: (r[0] or -1, r[2], round(r[5], 6))
    expected = sorted(language_model([(r["doc_id"], r["text"]) for r in docs.collect()]), key=order)
    for got, want in zip(sorted(rows, key=order), expected, strict=True):
        assert got[:5] == want[:5] and got[5:] == pytest.approx(want[5:], rel=1e-9, abs=1e-9)
    assert lm.score_documents(empty(docs)).count() == 0


def test_language_model_without_training_texts(spark):
    held = next(d for d in range(1000) if zlib.crc32(str(d).encode()) % 10 == 0)
    row = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row["train_tokens"], row["n_known"], row["score"]) == (0, 0, 0.0)


def test_probabilities_add_up_to_one():
    texts = pa.chunked_array([pa.array(["a b a c", "a b", "c"], pa.string())])
    block = lm.Block(texts)
    model = Counter(block.word.tolist())
    words = [float(model[i]) for i in range(len(block.words))]
    pairs = Counter(block.pair.tolist())
    import numpy as np

    once, twice = (sum(c == k for c in words) for k in (1, 2))
    built = lm.Automaton(block, np.array(words), np.array([float(pairs[i]) for i in range(len(block.pairs))]), int(sum(words)), len(words), once, twice, 0.1)
    off = once / (once + 2 * twice) if once and twice else 0.5
    assert sum(10 ** built.root) + off * len(words) / sum(words) == pytest.approx(1)


def toxic_table(spark):
    clean = "this is plain text. it says little, and it says it kindly\nanother sentence here. "
    rows = [(i, clean * (1 + i % 3) + f"number {i}" + (". you worthlessly scummy thing number" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_learns_and_locates(spark):
    table = toxic_table(spark)
    labels = table.select("doc_id", "toxic")
    docs = table.select("doc_id", "text").withColumn("score", table.doc_id)
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(rows) == 200 and held
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)
    for row in held:
        if row["predicted"]:
            assert [row["text"][s["start"] : s["end"]] for s in row["offending"]] == ["you worthlessly scummy thing number"]


def test_toxicity_of_odd_texts(spark):
    docs = odd_documents(spark, "offending string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (8, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 for r in rows if not (r["text"] or "").strip())
    model = toxicity.fit(empty(docs), empty(labels))
    assert toxicity.score(empty(docs), model).count() == 0


def test_toxicity_folds_case():
    data, _ = utf8(pa.array(["ÀÉ× Öß aZ"]))
    assert toxicity.fold(data).tobytes().decode() == "àé× öß az"


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
