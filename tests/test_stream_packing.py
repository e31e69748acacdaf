import datetime as dt
import random

import pytest

from blockprep.config import PrepConfig
from blockprep.streaming.packing import SAMPLE_SCHEMA, pack_stream, pack_windows

CFG = PrepConfig(context_length=16, block_size=4, micro_batch=2)
START = dt.datetime(2024, 1, 1)


def samples():
    rng = random.Random(4)
    return [(i, [5 + rng.randrange(9) for _ in range(rng.randrange(1, 11))], START + dt.timedelta(minutes=7 * i)) for i in range(60)]


def run(spark, tmp_path, cuts, name, late="1 day"):
    """Write parts of the samples one after the other, with the stream stopped in between."""
    rows = samples()
    source, sink, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
    end = (10_000, [5], START + dt.timedelta(days=40))
    for number, part in enumerate([*cuts, [end]]):
        part = [rows[i] if isinstance(i, int) else i for i in part]
        spark.createDataFrame(part, SAMPLE_SCHEMA).coalesce(1).write.parquet(f"{source}/trigger={number}")
        pack_stream(spark, source, CFG, sink, state, "1 hour", 2, late).awaitTermination()
    return sorted((r.batch_id, tuple(r.input_ids)) for r in spark.read.parquet(sink).collect())


def test_any_split_in_triggers_gives_the_batch_result(spark, tmp_path):
    batch = pack_windows(spark.createDataFrame(samples(), SAMPLE_SCHEMA), CFG, "1 hour", 2)
    expected = sorted((r.batch_id, tuple(r.input_ids)) for r in batch.collect())
    assert len(expected) < 60 and all(len(ids) == 16 for _, ids in expected)
    assert run(spark, tmp_path, [list(range(60))], "one") == expected
    shuffled = random.Random(1).sample(range(60), 60)
    # Out of order, and with samples that come twice, as a replayed trigger brings them.
    assert run(spark, tmp_path, [shuffled[:20], shuffled[10:45], shuffled[45:]], "three") == expected


def test_contexts_close_as_time_goes_on(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = samples()
    for number, part in enumerate([rows[:30], rows[30:]]):
        spark.createDataFrame(part, SAMPLE_SCHEMA).coalesce(1).write.parquet(f"{source}/trigger={number}")
        pack_stream(spark, source, CFG, sink, state, "1 hour", 2, "1 minute").awaitTermination()
        closed = {r.batch_id for r in spark.read.parquet(sink).collect()}
        assert closed if number else True
    batch = pack_windows(spark.createDataFrame(rows, SAMPLE_SCHEMA), CFG, "1 hour", 2)
    everything = {r.batch_id for r in batch.collect()}
    assert closed < everything


@pytest.mark.parametrize("size", [1, 3])
def test_sizes(spark, size):
    cfg = PrepConfig(context_length=16, block_size=4, micro_batch=size, pad_to_context=False)
    rows = [(i, [7] * (i + 1), START) for i in range(4)]
    made = pack_windows(spark.createDataFrame(rows, SAMPLE_SCHEMA), cfg, "1 hour", 1).collect()
    assert sorted(len(r.input_ids) for r in made) in ([4, 4, 4, 4], [4, 12])
    assert pack_windows(spark.createDataFrame([], SAMPLE_SCHEMA), cfg, "1 hour", 1).count() == 0
