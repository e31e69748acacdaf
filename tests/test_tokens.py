import hashlib
import re

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockprep.config import PrepConfig
from blockprep.functions.arrays import append_eos, fit_context, pad_block
from blockprep.functions.text import render_message, split_tokens, token_pattern
from blockprep.operators import tokens
from blockprep.operators.messages import message_rows
from blockprep.operators.tokens import detokenize, prompt_ids, token_ids, tokenize, tokenize_with
from blockprep.operators.vocabulary import (
    bind_vocab,
    build_vocab,
    count_tokens,
    ensure_token,
    id_list,
    special_tokens,
    suppressed_ids,
)
from blockprep.plans.registry import QUERIES

CFG = PrepConfig(block_size=4, context_length=16, vocab_size=50)
PATTERN = regex.compile(token_pattern(CFG))


def render(messages):
    return "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in messages)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t<|>MASKim_stardneofx12é漢,", max_size=60))
def test_split_is_lossless_and_finds_marks(text):
    tokens = PATTERN.findall(text)
    assert "".join(tokens) == text
    marks = re.findall(r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|\|<MASK>\|", text)
    assert [t for t in tokens if t in marks] == marks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n<|>MASKim_end7", max_size=20), max_size=5))
def test_messages_split_independently(contents):
    messages = [("user", c) for c in contents]
    apart = [t for m in messages for t in PATTERN.findall(render([m]))]
    assert PATTERN.findall(render(messages)) == apart
    assert all(len(PATTERN.findall(render([m]))) >= 4 for m in messages)


def test_split_in_spark_matches(spark):
    texts = ["", " a  b", "x <|im_end|> |<MASK>|", "longword" * 10, "été 12,5\r\n", "\U0001d54f́ \u000b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(split_tokens("t", CFG).alias("s")).collect()]
    assert got == [PATTERN.findall(t) for t in texts]


def samples(spark):
    rows = [
        (1, [("user", "a b c"), ("assistant", "d")]),
        (2, []),
        (3, [("user", "w " * 40)]),
        (4, [("user", "x")] * 9),
        (5, [("user", "|<MASK>| <|endoftext|>")]),
    ]
    return rows, spark.createDataFrame(rows, "sample_id long, messages array<struct<role:string,content:string>>")


def coded(tokens, ids, cfg):
    """Ids of tokens; those of their bytes where they have none."""
    parts = [[ids[t]] if t in ids else [cfg.byte_base + b for b in t.encode()] for t in tokens]
    return [i for part in parts for i in part]


def test_nothing_is_lost_outside_the_vocabulary(spark):
    cfg = PrepConfig(context_length=4096, vocab_size=3)
    text = "alpha beta gamma naïve 中文 👍 |<MASK>| 12"
    rows = spark.createDataFrame([(1, [("user", text)])], "sample_id long, messages array<struct<role:string,content:string>>")
    messages = message_rows(rows)
    vocab = build_vocab(count_tokens(messages, cfg), cfg)
    back = detokenize(token_ids(messages, vocab, cfg), vocab, cfg, ["sample_id"]).first().text
    assert back == f"user\n{text.replace('|<MASK>|', '')}\n"
    cut = PrepConfig(context_length=9, vocab_size=3)
    [row] = detokenize(tokenize(messages, vocab, cut), vocab, cut, ["sample_id"]).collect()
    assert f"user\n{text}".startswith(row.text) and row.text


def test_large_ids_survive(spark):
    big = 2**24 + 5
    vocab = spark.createDataFrame([("a", big, False), ("<unk>", 2, True)], "token string, token_id int, is_special boolean")
    vocab, cfg = bind_vocab(vocab, PrepConfig(context_length=64))
    assert (cfg.mask_id, cfg.eos_id, cfg.unknown_id, cfg.byte_fallback) == (big + 1, None, 2, False)
    rows = spark.createDataFrame([(1, [("a", "b")])], "sample_id long, messages array<struct<role:string,content:string>>")
    ids = token_ids(message_rows(rows), vocab, cfg).first().input_ids
    assert set(ids) == {big, 2} and ids.count(big) == 1
    with pytest.raises(ValueError):
        bind_vocab(vocab.where("token = 'a'"), PrepConfig())


def test_own_mask_token(spark):
    cfg = PrepConfig(context_length=64, mask_token="[MASK]", mask_id=7)
    rows = spark.createDataFrame([(1, [("user", "x [MASK] y")])], "sample_id long, messages array<struct<role:string,content:string>>")
    messages = message_rows(rows)
    vocab = build_vocab(count_tokens(messages, cfg), cfg)
    assert 7 in token_ids(messages, vocab, cfg).first().input_ids


def test_token_ids_against_whole_texts(spark):
    rows, df = samples(spark)
    messages = message_rows(df)
    vocab = build_vocab(count_tokens(messages, CFG), CFG)
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert len(set(ids.values())) == len(ids)
    expected = {}
    for key, turns in rows:
        cut = coded(PATTERN.findall(render(turns)), ids, CFG)[: CFG.context_length]
        expected[key] = cut if cut and cut[-1] == 1 else [*cut, 1]
    for parts in (1, 7):
        got = tokenize(messages.repartition(parts), vocab, CFG).collect()
        assert {r.sample_id: r.input_ids for r in got} == expected
    assert {r.sample_id: r.input_ids for r in token_ids(messages, vocab, CFG).collect()}[2] == []
    prompts = {r.sample_id: r.input_ids for r in prompt_ids(df, vocab, CFG).collect()}
    for key, turns in rows:
        text = render(turns) + "<|im_start|>assistant\n"
        assert prompts[key] == coded(PATTERN.findall(text), ids, CFG)


def test_vocabulary_order_and_cap(spark):
    counts = spark.createDataFrame(
        [("b", 3), ("a", 3), ("c", 9), ("d", 1), ("|<MASK>|", 99)], "token string, n long"
    )
    vocab = build_vocab(counts, PrepConfig(vocab_size=3))
    corpus = vocab.where("not is_special AND token_id < 8").orderBy("token_id").collect()
    assert vocab.where("token_id BETWEEN 8 AND 263").count() == 256
    assert [(r.token, r.token_id) for r in corpus] == [("c", 5), ("a", 6), ("b", 7)]


def test_ensure_token_and_suppression(spark):
    vocab = special_tokens(spark)
    assert ensure_token(vocab, "|<MASK>|").count() == vocab.count()
    [new] = ensure_token(vocab, "<x>").where("token = '<x>'").collect()
    assert (new.token_id, new.is_special) == (5, True)
    assert id_list(suppressed_ids(vocab, PrepConfig())).first().token_ids == [0, 3, 4]
    assert id_list(suppressed_ids(vocab, PrepConfig(pad_id=9, bos_id=8))).first().token_ids == [0, 3, 4, 8, 9]
    assert id_list(suppressed_ids(vocab, PrepConfig(eos_id=4))).first().token_ids == [0, 3]
    assert id_list(suppressed_ids(vocab, PrepConfig(eos_id=None))).first().token_ids == [0, 3, 4]


def test_array_rules(spark):
    cases = [[], [5, 1], [5, 6, 7, 1], [5, 6, 7, 8, 9]]
    df = spark.createDataFrame([(c,) for c in cases], "ids array<int>")
    got = df.select(
        append_eos("ids", 1).alias("e"),
        append_eos("ids", None).alias("n"),
        pad_block("ids", 4, 0).alias("p"),
        fit_context("ids", 4, 0).alias("f"),
    ).collect()
    assert [r.e for r in got] == [[1], [5, 1], [5, 6, 7, 1], [5, 6, 7, 8, 9, 1]]
    assert [r.n for r in got] == cases
    assert [r.p for r in got] == [[], [5, 1, 0, 0], [5, 6, 7, 1], [5, 6, 7, 8, 9, 0, 0, 0]]
    assert [r.f for r in got] == [[0, 0, 0, 0], [5, 1, 0, 0], [5, 6, 7, 1], [5, 6, 7, 8]]


def test_tokenizer_hook(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in (0, 3, 40)], "sample_id long, text string")

    def encode(texts):
        return [[7] * len(t) for t in texts]

    got = {r.sample_id: r.input_ids for r in tokenize_with(df, encode, CFG).collect()}
    assert got == {0: [1], 3: [7, 7, 7, 1], 40: [7] * 16 + [1]}


def test_a_callers_tokenizer_gets_few_characters_at_once(spark):
    df = spark.range(40).selectExpr("id AS sample_id", "repeat('x', 200000) AS text").coalesce(1)
    coded = tokenize_with(df, lambda texts: [[len(texts)]] * len(texts), CFG).collect()
    assert sorted(r.sample_id for r in coded) == list(range(40))
    assert max(r.input_ids[0] for r in coded) <= 6


def test_detokenize(spark):
    vocab = special_tokens(spark).unionByName(
        spark.createDataFrame([("a", 5, False), (" b", 6, False)], "token string, token_id int, is_special boolean")
    )
    df = spark.createDataFrame([(1, [3, 5, 0, 6, 1]), (2, []), (3, [0, 1])], "k int, input_ids array<int>")
    got = {r.k: r.text for r in detokenize(df, vocab, CFG, ["k"]).collect()}
    assert got == {1: "a b", 2: "", 3: ""}


def test_lossless_ids_keeps_documents_beyond_a_million_ids(spark, tmp_path):
    """Most words have no id of their own, so that ids are about as many as bytes."""
    texts = {1: " ".join(f"{i * 7919 % 999983:x}é" for i in range(200_000)), 2: "short one"}
    assert len(texts[1].encode()) > 2**20
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(QUERIES["lossless_ids"](spark, str(tmp_path)).collect())
    assert got == {k: hashlib.md5(f"user\n{t}\n".encode()).hexdigest() for k, t in texts.items()}


def test_tokens_are_looked_up_without_a_row_each(spark, capsys):
    vocab = special_tokens(spark)
    rows = spark.createDataFrame([(1, 0, "user", "a b")], "sample_id long, ord int, role string, content string")
    coded_rows = token_ids(rows, vocab, CFG)
    detokenize(coded_rows, vocab, CFG, ["sample_id"]).explain()
    assert "Generate" not in capsys.readouterr().out


@pytest.mark.parametrize("fallback", [True, False])
def test_rows_and_joined_tokens_give_the_same_ids_where_places_repeat(spark, fallback):
    given = [(1, 0, "user", "a é b"), (1, 0, "user", "漢 a"), (1, 1, "tool", ""), (2, 0, None, None), (None, 0, "user", "a"), (None, 0, "user", "b b")]
    rows = spark.createDataFrame(given, "sample_id long, ord int, role string, content string")
    vocab = special_tokens(spark).unionByName(spark.createDataFrame([("a", 5, False), (" b", 6, False)], "token string, token_id int, is_special boolean"))
    cfg = PrepConfig(block_size=4, context_length=40, vocab_size=50, byte_fallback=fallback)
    got = {r.sample_id: r.input_ids for r in token_ids(rows, vocab, cfg).collect()}
    pieces = rows.select("sample_id", "ord", F.posexplode_outer(split_tokens(render_message("role", "content"), cfg)).alias("i", "token"))
    place = F.col("ord").cast("long") * cfg.context_length + F.col("i")
    plain = tokens._regroup(tokens._lookup(pieces, vocab, cfg), "sample_id", place, cfg.context_length)
    assert got == {r.sample_id: r.input_ids for r in plain.collect()}
