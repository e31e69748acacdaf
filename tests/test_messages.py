import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockprep.functions.text import render_chat, strip
from blockprep.operators.history import epoch_messages, history_messages, history_prompts
from blockprep.operators.messages import (
    fold_turns,
    message_rows,
    non_blank,
    pairs_to_messages,
    prompt_messages,
    rejected_rows,
    to_messages,
    turn_rows,
)
from blockprep.operators.running import running_totals
from blockprep.sources.instructions import read_instructions

KEY = T.StructField("sample_id", T.LongType())

CASES = [
    # (row, expected messages or None when rejected)
    (
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        [("user", "q"), ("assistant", "a")],
    ),
    ({"messages": [], "instruction": "x"}, []),
    ({"messages": [{"role": "user", "content": None}]}, [("user", "None")]),
    ({"messages": "str", "instruction": "y"}, [("user", "y"), ("assistant", "")]),
    ({"messages": [{"content": "q"}]}, None),
    ({"messages": [None]}, None),
    ({"messages": [{"role": "tool", "content": "x"}]}, [("tool", "x")]),
    (
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        [("user", "h"), ("assistant", "g")],
    ),
    (
        {"conversations": [{"role": "tool", "content": "x"}, {"value": "y"}]},
        [("system", "x"), ("system", "y")],
    ),
    ({"conversations": [{"role": "", "from": "human", "content": "", "value": "v"}]}, [("user", "v")]),
    ({"conversations": [{"role": "user", "content": None, "value": None}]}, [("user", "")]),
    ({"conversations": [], "prompt": "p"}, []),
    (
        {"instruction": "i", "input": "x", "output": "o"},
        [("user", "i\n\nx"), ("assistant", "o")],
    ),
    ({"instruction": "i", "input": " "}, [("user", "i\n\n "), ("assistant", "")]),
    (
        {"instruction": "", "question": "q", "answer": "a"},
        [("user", "q"), ("assistant", "a")],
    ),
    ({}, [("user", ""), ("assistant", "")]),
    ({"messages": None, "prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rows") / "rows.jsonl"
    lines = [json.dumps({"sample_id": i, **row}) for i, (row, _) in enumerate(CASES)]
    path.write_text("\n".join([*lines, "{bad"]) + "\n", encoding="utf-8")
    return read_instructions(spark, str(path), keys=[KEY])


def test_three_shapes(rows):
    found = {
        r.sample_id: [(m.role, m.content) for m in r.messages] for r in to_messages(rows).collect()
    }
    expected = {i: m for i, (_, m) in enumerate(CASES) if m is not None}
    assert found == expected


def test_rejected_rows_are_kept_aside(rows):
    rejected = [r.sample_id for r in rejected_rows(rows).select("sample_id", "prompt").collect()]
    assert sorted(rejected, key=str) == sorted(
        [i for i, (_, m) in enumerate(CASES) if m is None] + [None], key=str
    )


def test_message_rows_keep_empty_samples(rows):
    kept = message_rows(to_messages(rows)).where("sample_id = 1").collect()
    assert [(r.ord, r.role, r.content) for r in kept] == [(0, None, None)]


def test_missing_columns_count_as_null(spark):
    df = spark.createDataFrame([(1, "q")], "sample_id long, question string")
    [row] = to_messages(df).collect()
    assert [(m.role, m.content) for m in row.messages] == [("user", "q"), ("assistant", "")]


def test_multiline_array(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text(json.dumps([{"prompt": "a"}, {"prompt": "b"}], indent=2), encoding="utf-8")
    back = read_instructions(spark, str(path), multiline=True)
    assert sorted(r.prompt for r in back.collect()) == ["a", "b"]


def test_strip_and_blank(spark):
    df = spark.createDataFrame([(" \t　a b\n ",), (" \n",), ("",)], "t string")
    assert [r.t for r in df.select(strip("t").alias("t")).collect()] == ["a b", "", ""]
    assert non_blank(df, "t").count() == 1


def test_pairs_to_messages(spark):
    df = spark.createDataFrame(
        [(1, [("u1", "a1"), ("u2", ""), ("u3", None)], "new")],
        "id int, history array<struct<user:string,assistant:string>>, message string",
    )
    [row] = pairs_to_messages(df, "history", "message", ["id"]).collect()
    assert [(m.role, m.content) for m in row.messages] == [
        ("user", "u1"),
        ("assistant", "a1"),
        ("user", "u2"),
        ("user", "u3"),
        ("user", "new"),
    ]


def test_prompt_text(spark):
    df = spark.createDataFrame([(1, "hi")], "id int, text string")
    [row] = prompt_messages(df, "text", ["id"]).select(render_chat("messages", True).alias("t")).collect()
    assert row.t == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"


TURNS = "conv_id long, turn long, role string, text string"


def test_history_commands(spark):
    texts = [
        ("user", "a"),
        ("assistant", "reply"),
        ("user", " Clear "),
        ("user", "c"),
        ("assistant", " reply "),
        ("user", "  "),
        ("user", "e"),
        ("user", "exit"),
        ("user", "z"),
    ]
    turns = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(texts)], TURNS)
    kept = history_messages(turns).orderBy("turn").collect()
    prompts = [
        [m.content for m in kept if m.epoch == p.epoch and m.ord < p.n_messages]
        for p in history_prompts(turns).orderBy("turn").collect()
    ]
    assert prompts == [["a"], ["c"], ["c", "reply", "e"]]
    assert {r.sample_id for r in epoch_messages(turns).collect()} == {"7:0", "7:1"}


def test_fold_in_pieces_and_dense_order(spark):
    turns = spark.createDataFrame(
        [(c, t * 3 + 5, "user", f"{c}-{t}") for c, n in ((1, 7), (2, 3)) for t in range(n)], TURNS
    ).repartition(5)
    folded = fold_turns(turns, piece=3).orderBy("conv_id", "piece").collect()
    assert [(r.conv_id, r.piece, len(r.messages)) for r in folded] == [
        (1, 0, 3),
        (1, 1, 3),
        (1, 2, 1),
        (2, 0, 3),
    ]
    assert [m.content for r in folded if r.conv_id == 1 for m in r.messages] == [
        f"1-{t}" for t in range(7)
    ]
    assert [r.ord for r in turn_rows(turns).where("sample_id = 1").orderBy("ord").collect()] == list(range(7))


def test_running_totals_over_many_stretches(spark):
    # One key holds most rows and spans many stretches.
    data = [(1, i, i % 5) for i in range(500)] + [(k, i, 1) for k in (2, 3) for i in range(9)]
    df = spark.createDataFrame(data, "k int, o long, v long").repartition(7)
    got = running_totals(df, ["k"], "o", {"s": F.col("v"), "n": F.lit(1)}, stretch=16)
    seen: dict = {}
    expected = set()
    for k, o, v in sorted(data):
        s, n = seen.get(k, (0, 0))
        seen[k] = (s + v, n + 1)
        expected.add((k, o, v, s + v, n + 1))
    assert {tuple(r) for r in got.select("k", "o", "v", "s", "n").collect()} == expected
