"""The queries' own columns against plain Python, on given documents and odd ones."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

from blockprep.llm import queries
from tests.llm.odd import odd_documents

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Given tables, with odd documents among the documents (their ids from 10,000 on)."""
    path = str(tmp_path_factory.mktemp("tables"))
    odd = odd_documents(spark).withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    docs.unionByName(odd).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def held(doc_id, folds):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def test_op1(spark, folder, docs):
    rows = queries.op1_sharding(spark, folder).collect()
    sizes = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, *sizes(t)) for d, t in docs)
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


@pytest.fixture(scope="module")
def encoder():
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=load_tiktoken_bpe(queries.BPE_RANKS), special_tokens={})


def test_op4(spark, folder, docs, encoder):
    """A token goes to the line with most of its characters, then the first; lines keep their newline."""
    expected = Counter()
    for doc_id, text in docs:
        ids = encoder.encode_ordinary(text or "")
        if not ids:
            expected[doc_id, None, 0, 0] += 1
            continue
        line_of = np.cumsum([0] + [c == "\n" for c in text])[:-1].tolist()
        char_of = [i for i, c in enumerate(text) for _ in c.encode()]
        own, at = Counter(), 0
        for token in ids:
            n = len(encoder.decode_single_token_bytes(token))
            chars = range(char_of[at], char_of[at + n - 1] + 1)
            at += n
            parts = Counter(line_of[c] for c in chars)
            own[min(parts, key=lambda x: (-parts[x], x))] += 1
        lines = len(re.findall(r"[^\n]*\n|[^\n]+$", text))
        for k in range(lines):
            expected[doc_id, k, own[k], len(ids)] += 1
    rows = queries.op4_token_counts(spark, folder).collect()
    assert Counter((r["doc_id"], r["section"], r["n_tokens"], r["doc_tokens"]) for r in rows) == expected


def test_op7(spark, folder, docs):
    rows = queries.op7_toxicity(spark, folder).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in rows) == Counter((d, held(d, 5)) for d, _ in docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    by_text, text = defaultdict(set), dict(docs)
    for r in rows:
        if r["doc_id"] is not None:
            by_text[text[r["doc_id"]]].add(r["score"])
    assert all(len(scores) == 1 for scores in by_text.values())


def test_op8(spark, folder, docs, encoder):
    expected = Counter()
    for doc_id, text in docs:
        ids = encoder.encode_ordinary(text or "")
        digests = (np.array(ids, "<u4").tobytes(), (text or "").encode())
        expected[doc_id, len(ids), *(hashlib.sha256(x).hexdigest() for x in digests)] += 1
    rows = queries.op8_byte_bpe(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == expected


def test_op10(spark, folder, docs):
    small = {c: c + 32 for c in range(65, 91)}
    tokens = [(d, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(small)), None]) for d, t in docs]
    known = Counter(x for d, own in tokens if not held(d, 10) for x in own)
    total = sum(known.values())
    base = {x: math.log10((known[x] + 0.1) / (total + 0.1 * (len(known) + 1))) for _, own in tokens for x in own}
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    expected = sorted(((d, held(d, 10), len(own), sum(known[x] > 0 for x in own), total, sum(base[x] for x in own)) for d, own in tokens), key=order)
    rows = queries.op10_lm_scoring(spark, folder).collect()
    names = "doc_id held_out n_tokens n_known train_tokens base_score".split()
    for got, want in zip(sorted((tuple(r[n] for n in names) for r in rows), key=order), expected, strict=True):
        assert got[:5] == want[:5] and got[5] == pytest.approx(want[5], rel=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
