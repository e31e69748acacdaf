import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from blockprep.llm import bpe, token_counts
from blockprep.llm.common import utf8
from tests.llm.odd import empty, odd_documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.Ranks(bpe.read_ranks(PATH))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS.rank, special_tokens={})


def encoded(texts):
    return bpe.encode_piece(*utf8(pa.array(texts, pa.string())), bpe.code_classes(), bpe.Cache(RANKS))


def test_equals_the_library_on_random_texts():
    rng = random.Random(3)
    parts = ["a", "s", "t", "re", "ve", "ll", "d", "'", "'s", " ", "  ", "\n", "\t", "1", "²", "é", "中", "!", "-", " ", "　", "👍", "́", "R"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(5000)]
    texts += ["a" * 3000, "ab'" * 700, " " * 900 + "x", "", None, "'s's'll'x"]
    for text, ids in zip(texts, encoded(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text or ""), text


def test_slices_do_not_cross_rows():
    assert encoded(["a", "b", " ", "c"]) == [encoded([x])[0] for x in ["a", "b", " ", "c"]]


def test_long_slices_merge_like_short_ones(monkeypatch):
    words = [b"international", "naïveté".encode() * 3, b"aaaaaaaaaaaaaaaaaa", b"x"]
    short = [RANKS.merge(w) for w in words]
    monkeypatch.setattr(bpe, "HEAP_FROM", 0)
    assert [RANKS.merge(w) for w in words] == short


def test_round_trip_and_clashes(spark):
    docs = odd_documents(spark, "ids string, decoded string, note string")
    rows = bpe.decode(bpe.encode(docs, PATH), PATH, ends="ends").collect()
    assert len(rows) == docs.count()
    for row in rows:
        ids = np.frombuffer(row["ids"], "<u4")
        assert ids.tolist() == LIBRARY.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
        assert len(row["ends"]) == len(ids) and row["note"] == "x"
    assert bpe.encode(empty(docs), PATH).count() == 0


def test_section_counts_add_up(spark):
    docs = odd_documents(spark, "sections string")
    for row in token_counts.count_tokens(docs, PATH).collect():
        text = row["text"] or ""
        assert row["n_tokens"] == len(LIBRARY.encode_ordinary(text)) == sum(s["n_tokens"] for s in row["sections"])
        assert "".join(text[s["start"] : s["end"]] for s in row["sections"]) == text
    assert token_counts.section_rows(token_counts.count_tokens(empty(docs), PATH)).count() == 0
    rows = token_counts.section_rows(token_counts.count_tokens(docs, PATH)).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    blank = [r for r in rows if r["section"] is None]
    assert sorted(r["doc_id"] or -1 for r in blank) == [-1, 7, 8]
    assert all((r["start"], r["end"], r["n_tokens"], r["n_crossing"], r["doc_tokens"]) == (None, None, 0, 0, 0) for r in blank)
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] == 12) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 12)


def test_boundary_rule():
    # Tokens [0, 4) [4, 7) [7, 8) over sections [0, 2) [2, 6) [6, 8): a tie goes to the first.
    starts, ends = np.array([0, 4, 7]), np.array([4, 7, 8])
    assert token_counts.owners(starts, ends, np.array([0, 2, 6]), 8).tolist() == [0, 1, 2]
    assert token_counts.owners(np.array([0]), np.array([9]), np.array([0, 1, 3]), 9).tolist() == [2]


def test_encoders_of_a_task_give_the_same_ids(spark):
    docs = odd_documents(spark).select("doc_id", "text")
    own, kept = (bpe.encode(docs, PATH, slices=n).select("text", "ids").collect() for n in (7, None))
    key = lambda r: (r.text or "", r.text is None)
    assert sorted(own, key=key) == sorted(kept, key=key)
