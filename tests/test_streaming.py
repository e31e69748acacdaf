import json

import pytest
from pyspark.sql import types as T

from blockprep.config import PrepConfig
from blockprep.functions.text import render_chat
from blockprep.operators.messages import message_rows, to_messages
from blockprep.plans.prepare import freeze_vocab
from blockprep.sources.instructions import read_instructions
from blockprep.sources.prepared import check_manifest
from blockprep.streaming import ingest

KEY = T.StructField("sample_id", T.LongType())
CFG = PrepConfig(block_size=4, context_length=16, vocab_size=30)


def write(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")


FIRST = [{"sample_id": i, "prompt": f"question {i}", "answer": "a" * i} for i in range(6)]
SECOND = [
    {"sample_id": 10, "messages": [{"role": "user", "content": "late"}]},
    {"sample_id": 11, "conversations": [{"from": "human", "value": "later"}]},
    {"sample_id": 12, "messages": [{"content": "no role"}]},
]


def test_rendered_rows_arrive_once(spark, tmp_path):
    source, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    write(source, "1.jsonl", FIRST)
    rows = ingest.stream_instructions(spark, str(source), [KEY])
    ingest.ingest_rendered(rows, ["sample_id"], sink, state).awaitTermination()
    assert spark.read.parquet(sink).count() == 6
    write(source, "2.jsonl", SECOND)
    ingest.ingest_rendered(rows, ["sample_id"], sink, state).awaitTermination()
    batch = to_messages(read_instructions(spark, str(source), keys=[KEY]), ["sample_id"])
    expected = {(r.sample_id, r.text) for r in batch.select("sample_id", render_chat("messages").alias("text")).collect()}
    got = [(r.sample_id, r.text) for r in spark.read.parquet(sink).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_views_do_not_depend_on_triggers(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "1.jsonl", FIRST)
    write(source, "2.jsonl", SECOND)
    messages = message_rows(to_messages(read_instructions(spark, str(source), keys=[KEY])))
    vocab_path = str(tmp_path / "vocab")
    vocab = freeze_vocab(messages, CFG, vocab_path)
    expected = {
        (r.batch_id, r.view, tuple(r.input_ids), tuple(r.labels))
        for r in ingest.sample_views(messages, vocab, CFG).collect()
    }
    for per_trigger in (1, 2):
        sink, state = str(tmp_path / f"out{per_trigger}"), str(tmp_path / f"state{per_trigger}")
        rows = ingest.stream_instructions(spark, str(source), [KEY], files_per_trigger=per_trigger)
        ingest.ingest_views(rows, vocab_path, CFG, sink, state).awaitTermination()
        stored = [
            (r.batch_id, r.view, tuple(r.input_ids), tuple(r.labels))
            for r in ingest.read_ingested_views(spark, sink).collect()
        ]
        assert len(stored) == len(expected) and set(stored) == expected
        assert check_manifest(spark, sink, CFG)
    with pytest.raises(ValueError):
        ingest.ingest_views(rows, vocab_path, PrepConfig(micro_batch=2), sink, state)
