import random
import re
import zlib
from collections import Counter

from blockprep.llm import spelling
from blockprep.llm.queries import op12_spelling
from tests.llm.odd import empty, odd_documents

LOWER = {c: c + 32 for c in range(65, 91)}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups(words):
    out = {}
    for word, n in words.items():
        near = sorted(((-words[w], w) for w in words if is_near(w, word)))
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        out[word] = [n, len(near), form, words[form] if form else None]
    for word in out:
        root = word
        while out[root][2]:
            root = out[root][2]
        out[word].append(root)
    return out


def check(found, words):
    got = {r["word"]: [r["n"], r["n_near"], r["form"], r["form_n"], r["root"]] for r in found.collect()}
    assert found.count() == len(got)
    assert got == groups(words)


def test_random_words_over_a_small_alphabet(spark):
    rng = random.Random(1)
    made = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))): rng.choice([1, 2, 2, 4, 8, 9, 16]) for _ in range(300)}
    rows = [(w, n) for w, n in made.items()] + [(None, 3), ("", 4), ("a\u0000b", 5)]
    check(spelling.spelling_groups(spark.createDataFrame(rows, "word string, n long")), made)


def test_repeated_words_chains_and_empty_tables(spark):
    rows = [("word", 1), ("word", 2), ("ward", 6), ("warm", 12), ("swarm", 24), ("aaab", 2), ("aab", 4), ("aaaab", 4)]
    table = spark.createDataFrame(rows, "word string, n long")
    check(spelling.spelling_groups(table), {"word": 3, "ward": 6, "warm": 12, "swarm": 24, "aaab": 2, "aab": 4, "aaaab": 4})
    assert spelling.spelling_groups(empty(table)).count() == 0


def slipped(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_words_of_odd_documents(spark):
    docs = odd_documents(spark, "run string, word string, n string")
    docs = docs.unionByName(docs.limit(1).selectExpr("15L doc_id", "repeat('Straße straÿe naïveté ', 150000) text", "run", "word", "n"))
    words = spelling.count_words(spelling.with_slips(spelling.runs(docs), 97))
    expected = slipped([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert {r["word"]: r["n"] for r in words.collect()} == expected


def test_the_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    check(op12_spelling(spark, folder), slipped([tuple(r) for r in rows]))
