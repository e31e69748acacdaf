"""Texts to token ids and back."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockprep.config import BROADCAST_VOCAB, PrepConfig
from blockprep.functions.arrays import append_eos
from blockprep.functions.text import render_chat, render_message, split_tokens
from blockprep.operators.heavy import heavy_join

# A rendered message is at least this many tokens: both marks and two breaks.
LEAST_MESSAGE_TOKENS = 4

# Characters of the texts that a caller's tokenizer gets at once, one text at least.
ENCODE_CHARS = 2**20

# Tokens that are looked up at once, one message at least.
CODE_TOKENS = 2**20

# Ids and places below these numbers travel in one long.
ID_SPAN = 2**24
PLACE_SPAN = 2**38

# One character written in hex, byte by byte with a blank behind each.
_WHOLE = "([0-7]. |(?:C[2-9A-F]|D.) [89AB]. |E. [89AB]. [89AB]. |F[0-4] [89AB]. [89AB]. [89AB]. )"
_WHOLE_BYTES = re.compile(rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}", re.S)


def named_join(df: DataFrame, vocab: DataFrame, key: str, cfg: PrepConfig) -> DataFrame:
    """Left join with a vocabulary: broadcast up to ``BROADCAST_VOCAB`` tokens, else by frequency."""
    if cfg.vocab_size <= BROADCAST_VOCAB:
        return df.join(F.broadcast(vocab), key, "left")
    return heavy_join(df, vocab, key)


def _byte_ids(token: Column, cfg: PrepConfig) -> Column:
    """The ids of a token's UTF-8 bytes."""
    digits = F.hex(F.encode(token, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    return F.transform(
        places, lambda p: F.conv(F.substr(digits, p, F.lit(2)), 16, 10).cast("int") + cfg.byte_base
    )


def _lookup(tokens: DataFrame, vocab: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Add token_id, NULL outside the vocabulary, and for such tokens byte_ids.

    Without byte fallback they have the unknown id.
    """
    joined = named_join(tokens, vocab.select("token", "token_id"), "token", cfg)
    outside = F.col("token").isNotNull() & F.col("token_id").isNull()
    others = _byte_ids(F.col("token"), cfg) if cfg.byte_fallback else F.array(F.lit(cfg.unknown_id))
    return joined.withColumn("byte_ids", F.when(outside, others))


def _regroup(tokens: DataFrame, key: str, place: Column, length: int) -> DataFrame:
    """Ordered id lists per key, cut to ``length``.

    Rows of a message sit in one partition, so the map-side step already folds
    them.  Place and id travel in one long, a fifth of what a struct of them
    takes in the shuffle, and sort as such; only bytes and very large ids go in
    structs of their own.
    """
    place = place.cast("long")
    small = (F.col("token_id") < ID_SPAN) & (place < PLACE_SPAN)
    entry = F.when(small, place * ID_SPAN + F.col("token_id"))
    other = F.coalesce("byte_ids", F.when(~small, F.array("token_id")))
    entries = tokens.groupBy(key).agg(
        F.sort_array(F.collect_list(entry)).alias("e"),
        F.collect_list(F.when(other.isNotNull(), F.struct(place.alias("p"), other.alias("ids")))).alias("o"),
    )

    def id_of(e: Column) -> Column:
        return e.bitwiseAND(F.lit(ID_SPAN - 1)).cast("int")

    plain = F.transform(F.slice("e", 1, length), id_of)
    single = F.transform(
        "e", lambda e: F.struct(F.shiftright(e, 24).alias("p"), F.array(id_of(e)).alias("ids"))
    )
    mixed = F.transform(F.array_sort(F.concat(single, F.col("o"))), lambda s: s["ids"])
    return entries.select(
        key,
        F.when(F.size("o") == 0, plain).otherwise(F.slice(F.flatten(mixed), 1, length)).alias("input_ids"),
    )


def _stretches(sums: np.ndarray) -> list[tuple[int, int]]:
    """Rows from, to: stretches of some ``CODE_TOKENS`` by running sums over the rows."""
    borders = [0, *(np.flatnonzero(np.diff(sums // CODE_TOKENS)) + 1).tolist(), len(sums)]
    return list(zip(borders, borders[1:]))


def _code(tokens: pa.Array, known: pa.Array, ids: np.ndarray, cfg: PrepConfig) -> tuple[pa.Array, pa.Array]:
    """Token lists to id lists, and where in them each token starts."""
    flat, ends = tokens.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0))])
    place = pc.index_in(flat, value_set=known)
    outside = pc.is_null(place).to_numpy(zero_copy_only=False)
    others, sizes = flat.filter(pa.array(outside)), np.ones(len(flat), np.int64)
    if cfg.byte_fallback:
        sizes[outside] = pc.binary_length(others).to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(starts[-1], np.int32)
    out[starts[:-1][~outside]] = ids[place.drop_null().to_numpy()]
    if cfg.byte_fallback:
        raw = b"".join(others.cast(pa.binary()).to_pylist())
        out[np.repeat(outside, sizes)] = np.frombuffer(raw, np.uint8) + np.int32(cfg.byte_base)
    else:
        out[outside] = cfg.unknown_id
    own = starts[:-1] - np.repeat(starts[ends[:-1]], np.diff(ends))
    return (
        pa.ListArray.from_arrays(pa.array(starts[ends], pa.int32()), pa.array(out)),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own, pa.int32())),
    )


def _coded(messages: DataFrame, vocab: DataFrame, cfg: PrepConfig) -> DataFrame:
    """(sample_id, ord, tokens) to (sample_id, ord, ids, starts): a message is looked up as one row.

    The vocabulary is broadcast, as in the join; batches go through in stretches of some
    ``CODE_TOKENS`` tokens.
    """
    table = vocab.select("token", "token_id").toArrow()
    shared = messages.sparkSession.sparkContext.broadcast((table["token"].combine_chunks(), table["token_id"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = shared.value
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch["tokens"]), 0).to_numpy()
            for a, b in _stretches(np.cumsum(sizes)):
                part = batch.slice(a, b - a)
                coded, starts = _code(part["tokens"], known, ids, cfg)
                yield pa.RecordBatch.from_arrays([part["sample_id"], part["ord"], coded, starts], ["sample_id", "ord", "ids", "starts"])

    key, place = (messages.schema[c].dataType.simpleString() for c in ("sample_id", "ord"))
    return messages.mapInArrow(run, f"sample_id {key}, ord {place}, ids array<int>, starts array<int>")


def _join_messages(coded: DataFrame, length: int) -> DataFrame:
    """Ids of the messages of a sample in order, cut to ``length``.

    Messages that share a place, as repeated rows do, alternate token by token.
    """
    joined = coded.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("ord", "ids", "starts"))).alias("m"))

    def pieces(m: Column) -> Column:
        ends = F.concat(F.slice(m["starts"], F.lit(2), F.greatest(F.size(m["starts"]) - 1, F.lit(0))), F.array(F.size(m["ids"])))
        return F.transform(
            m["starts"],
            lambda s, i: F.struct(m["ord"].alias("ord"), i.alias("i"), F.slice(m["ids"], s + 1, F.get(ends, i) - s).alias("ids")),
        )

    order = F.transform("m", lambda m: m["ord"])
    plain = F.flatten(F.transform("m", lambda m: m["ids"]))
    mixed = F.flatten(F.transform(F.array_sort(F.flatten(F.transform("m", pieces))), lambda s: s["ids"]))
    ids = F.when(F.size(F.array_distinct(order)) == F.size("m"), plain).otherwise(mixed)
    return joined.select("sample_id", F.slice(ids, 1, length).alias("input_ids"))


def token_ids(messages: DataFrame, vocab: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Message rows to (sample_id, input_ids), cut to the context length, without EOS.

    Messages split independently of each other, so a conversation is never
    assembled as one text.  Message ``k`` has at least ``4 * k`` tokens in
    front of it; what cannot reach the first ``context_length`` tokens is left
    out before anything is exploded or shuffled.  That is exact, and it bounds
    every group no matter how long one conversation is.
    """
    room = F.lit(cfg.context_length) - F.col("ord") * F.lit(LEAST_MESSAGE_TOKENS)
    split = F.slice(split_tokens(render_message("role", "content"), cfg), F.lit(1), room.cast("int"))
    cut = messages.where(room > 0).select("sample_id", "ord", split.alias("tokens"))
    if cfg.vocab_size <= BROADCAST_VOCAB:
        return _join_messages(_coded(cut, vocab, cfg), cfg.context_length)
    pieces = cut.select("sample_id", "ord", F.posexplode_outer("tokens").alias("i", "token"))
    place = F.col("ord").cast("long") * cfg.context_length + F.col("i")
    return _regroup(_lookup(pieces, vocab, cfg), "sample_id", place, cfg.context_length)


def tokenize(messages: DataFrame, vocab: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Message rows to (sample_id, input_ids), cut, then ended with EOS."""
    return token_ids(messages, vocab, cfg).withColumn(
        "input_ids", append_eos("input_ids", cfg.eos_id)
    )


def prompt_ids(prompts: DataFrame, vocab: DataFrame, cfg: PrepConfig) -> DataFrame:
    """(sample_id, messages) to (sample_id, input_ids), ending in the open assistant turn.

    Prompts are whole, never cut; each is one input row already.
    """
    pieces = prompts.select(
        "sample_id",
        F.posexplode_outer(split_tokens(render_chat("messages", True), cfg)).alias("i", "token"),
    )
    return _regroup(_lookup(pieces, vocab, cfg), "sample_id", F.col("i"), 2**31 - 1)


def tokenize_with(
    samples: DataFrame,
    encode: Callable[[list[str]], list[list[int]]],
    cfg: PrepConfig,
    text: str = "text",
) -> DataFrame:
    """Hook for a caller's own tokenizer: (sample_id, text) to (sample_id, input_ids).

    ``encode`` maps a batch of texts to lists of ids; batches travel as Arrow
    and there is one worker per partition.  It is called with some
    ``ENCODE_CHARS`` characters at once, and its ids are cut before they travel
    back, so that a worker holds few ids as Python objects.
    """
    most = cfg.context_length
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chars = batch["text"].str.len().fillna(0).cumsum()
            for _, part in batch.groupby(chars // ENCODE_CHARS, sort=False):
                ids = [None if i is None else i[:most] for i in encode(part["text"].tolist())]
                yield pd.DataFrame({"sample_id": part["sample_id"].array, "input_ids": ids})

    key = samples.schema["sample_id"].dataType.simpleString()
    mapped = samples.select("sample_id", F.col(text).alias("text")).mapInPandas(
        run, f"sample_id {key}, input_ids array<int>"
    )
    return mapped.withColumn("input_ids", append_eos("input_ids", cfg.eos_id))


def _texts(lists: pa.Array, known: pa.Array, parts: pa.Array, cfg: PrepConfig) -> list[bytes]:
    """The text of each row's id lists; ids that are not ``known`` are left out."""
    rows, inner = pc.fill_null(pc.list_value_length(lists), 0).to_pylist(), lists.flatten()
    sizes = pc.list_value_length(inner).to_numpy()
    at = pc.index_in(inner.flatten(), value_set=known)
    places = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    shown = pc.fill_null(parts.take(at), b"")
    joined = pc.binary_join(pa.ListArray.from_arrays(places, shown), b"")
    coded, out, n = pc.fill_null(pc.less(at, 256 if cfg.byte_fallback else 0), False).to_numpy(zero_copy_only=False), [], 0
    for size in rows:
        a, b = places[n].as_py(), places[n + size].as_py()
        text = b"" if size != 1 else joined[n].as_py()
        if size > 1:
            # Rows that share their keys: their parts alternate, bytes as their names.
            spots = [i for k in range(n, n + size) for i in range(places[k + 1].as_py() - places[k].as_py())]
            named = [(i, b"%02X " % p[0] if c else p, c, p) for i, p, c, v in zip(spots, shown[a:b].to_pylist(), coded[a:b], at[a:b].is_valid().to_pylist()) if v]
            text = b"".join(e[-1] for e in sorted(named))
        out.append(b"".join(_WHOLE_BYTES.findall(text)) if coded[a:b].any() else text)
        n += size
    return out


def _detokenize_rows(
    sequences: DataFrame, vocab: DataFrame, cfg: PrepConfig, keys: Sequence[str], ids: str
) -> DataFrame:
    """``detokenize`` with the vocabulary broadcast and a sequence as one row."""
    hidden = F.coalesce("is_special", F.lit(False)) | (F.col("token_id") == cfg.mask_id)
    rows = vocab.select("token_id", "token", hidden.alias("hidden")).where("token_id IS NOT NULL").toArrow().to_pydict()
    names = {i: t for i, t, h in zip(rows["token_id"], rows["token"], rows["hidden"]) if t is not None and not h}
    without = {i for i, h in zip(rows["token_id"], rows["hidden"]) if h} | {cfg.mask_id}
    named = [(b + cfg.byte_base, bytes([b])) for b in range(256)] if cfg.byte_fallback else []
    named = [(-1 - b, p) if i in without else (i, p) for b, (i, p) in enumerate(named)]
    byte_ids = {i for i, _ in named}
    named += [(i, t.encode()) for i, t in names.items() if i not in byte_ids]
    table = pa.array([i for i, _ in named], pa.int32()), pa.array([p for _, p in named], pa.binary())
    shared = sequences.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = shared.value
        for batch in batches:
            lists = batch[len(keys)]
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            sums = np.concatenate([[0], np.cumsum(pc.list_value_length(lists.flatten()).to_numpy())])
            for a, b in _stretches(sums[ends]):
                text = _texts(lists.slice(a, b - a), known, parts, cfg)
                columns = [batch[k].slice(a, b - a) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(text, pa.binary())], [*keys, "text"])

    schema = T.StructType([*[T.StructField(k, sequences.schema[k].dataType) for k in keys], T.StructField("text", T.BinaryType())])
    grouped = sequences.groupBy(*keys).agg(F.collect_list(F.col(ids).cast("array<int>")).alias("_lists"))
    return grouped.mapInArrow(run, schema).withColumn("text", F.col("text").cast("string"))


def detokenize(
    sequences: DataFrame, vocab: DataFrame, cfg: PrepConfig, keys: Sequence[str], ids: str = "input_ids"
) -> DataFrame:
    """Id lists to text; special tokens and slots still masked are left out.

    Byte ids are put together to characters; bytes that make no whole one (the
    list was cut within it) are left out.
    """
    if cfg.vocab_size <= BROADCAST_VOCAB:
        return _detokenize_rows(sequences, vocab, cfg, keys, ids)
    slots = sequences.select(*keys, F.posexplode_outer(ids).alias("pos", "token_id"))
    names = vocab.select("token_id", "token", "is_special")
    byte = F.col("token_id") - cfg.byte_base
    is_byte = byte.between(0, 255) if cfg.byte_fallback else F.lit(False)
    part = F.when(is_byte, F.concat(F.lpad(F.hex(byte), 2, "0"), F.lit(" "))).otherwise(F.col("token"))
    shown = F.when(
        ~F.coalesce("is_special", F.lit(False)) & (F.col("token_id") != cfg.mask_id) & part.isNotNull(),
        F.struct("pos", part.alias("part"), is_byte.alias("byte")),
    )
    grouped = (
        named_join(slots, names, "token_id", cfg)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(shown)).alias("e"))
    )
    plain = F.array_join(F.transform("e", lambda e: e["part"]), "")
    coded = F.transform(
        "e",
        lambda e: F.when(e["byte"], e["part"]).otherwise(
            F.regexp_replace(F.hex(F.encode(e["part"], "UTF-8")), "(..)", "$1 ")
        ),
    )
    whole = F.array_join(F.regexp_extract_all(F.array_join(coded, ""), F.lit(_WHOLE), F.lit(1)), "")
    decoded = F.unhex(F.replace(whole, F.lit(" "), F.lit(""))).cast("string")
    text = F.when(F.exists("e", lambda e: e["byte"]), decoded).otherwise(plain)
    return grouped.select(*keys, text.alias("text"))
