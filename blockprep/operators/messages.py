"""Row shapes to messages, and messages to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockprep.functions.text import norm_role, strip, truthy, user_text
from blockprep.operators.running import running_totals
from blockprep.sources.instructions import INSTRUCTION_SCHEMA

# Messages per row of a folded conversation.  Longer conversations become
# several rows, so that no row (and no task) has to hold a whole one.
PIECE = 1024


def _message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def _with_all_columns(df: DataFrame) -> DataFrame:
    missing = [f for f in INSTRUCTION_SCHEMA.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def _is_rejected() -> Column:
    """Rows that have no message form: no role, no turn, or no JSON object.

    A record that is flagged only because one field has another type (say a
    text where a list is expected) still parses and is not rejected.
    """
    bad_message = F.exists("messages", lambda m: m.isNull() | m["role"].isNull())
    bad_turn = F.exists("conversations", lambda t: t.isNull())
    kind = F.schema_of_variant(F.try_parse_json("_corrupt_record"))
    bad_record = F.col("_corrupt_record").isNotNull() & ~F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    return F.coalesce(
        bad_record | F.when(F.col("messages").isNotNull(), bad_message).otherwise(F.coalesce(bad_turn, F.lit(False))),
        F.lit(False),
    )


def to_messages(df: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Normal form (keys, messages) of rows in any of the three shapes.

    A ``messages`` list wins over a ``conversations`` list, which wins over
    the flat columns; an empty list still wins.  Source columns are dropped.
    JSON numbers and booleans were read as their text, so ``0`` and ``false``
    are not empty here.
    """
    from_messages = F.transform(
        "messages", lambda m: _message(m["role"], F.coalesce(m["content"], F.lit("None")))
    )
    from_turns = F.transform(
        "conversations",
        lambda t: _message(
            norm_role(truthy(t["role"], t["from"])), truthy(t["content"], t["value"])
        ),
    )
    from_columns = F.array(
        _message(
            F.lit("user"),
            user_text(truthy("instruction", "prompt", "question"), truthy("input")),
        ),
        _message(F.lit("assistant"), truthy("output", "response", "answer")),
    )
    return _with_all_columns(df).where(~_is_rejected()).select(
        *keys,
        F.when(F.col("messages").isNotNull(), from_messages)
        .when(F.col("conversations").isNotNull(), from_turns)
        .otherwise(from_columns)
        .alias("messages"),
    )


def rejected_rows(df: DataFrame) -> DataFrame:
    """The rows that ``to_messages`` leaves out, with all their columns."""
    return _with_all_columns(df).where(_is_rejected())


def message_rows(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row per message: (sample_id, ord, role, content).

    An empty list keeps one row whose role is NULL, so its sample survives.
    """
    return df.select(F.col(key).alias("sample_id"), F.posexplode_outer("messages").alias("ord", "m")).select(
        "sample_id", F.coalesce("ord", F.lit(0)).alias("ord"), "m.role", "m.content"
    )


def sample_keys(messages: DataFrame) -> DataFrame:
    """The sample ids of message rows: message 0 stands for its sample."""
    return messages.where(F.col("ord") == 0).select("sample_id")


def with_sample_ids(df: DataFrame, name: str = "sample_id") -> DataFrame:
    """Rows without an id get one: a hash of their content, and a number among equal rows.

    Reading the same rows again, in any order or split, gives the same ids; equal rows are
    numbered from 0, in stretches, so that many copies of a row are no single task's.
    """
    content = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    keyed = df.withColumn("_content", content).withColumn("_place", F.monotonically_increasing_id())
    counted = running_totals(keyed, ["_content"], "_place", {"_seen": F.lit(1)})
    return counted.withColumn(
        name, F.concat_ws("-", "_content", (F.col("_seen") - 1).cast("string"))
    ).select(name, *df.columns)


def rejected_turns(turns: DataFrame) -> DataFrame:
    """Turns without a role, which have no message form."""
    return turns.where(F.col("role").isNull())


def turn_rows(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turn rows as message rows: turns renumbered 0, 1, ... in each conversation.

    Turns without a role are left out; ``rejected_turns`` has them.
    """
    counted = running_totals(turns.where(F.col("role").isNotNull()), [key], "turn", {"_seen": F.lit(1)})
    return counted.select(
        F.col(key).alias("sample_id"),
        (F.col("_seen") - 1).alias("ord"),
        "role",
        F.coalesce("text", F.lit("")).alias("content"),
    )


def fold_turns(turns: DataFrame, key: str = "conv_id", piece: int = PIECE) -> DataFrame:
    """Turn rows as message lists: (key, piece, messages), in turn order.

    Piece 0 holds the first ``piece`` messages, piece 1 the next, and so on.
    """
    numbered = turn_rows(turns, key).withColumn("piece", F.floor(F.col("ord") / F.lit(piece)))
    folded = numbered.groupBy("sample_id", "piece").agg(
        F.array_sort(F.collect_list(F.struct("ord", "role", "content"))).alias("m")
    )
    return folded.select(
        F.col("sample_id").alias(key),
        "piece",
        F.transform("m", lambda m: _message(m["role"], m["content"])).alias("messages"),
    )


def pairs_to_messages(df: DataFrame, history: str, message: str, keys: Sequence[str]) -> DataFrame:
    """(user, assistant) pairs plus a new user text as messages; empty answers are skipped."""
    turns = F.flatten(
        F.transform(
            history,
            lambda p: F.array(
                _message(F.lit("user"), p["user"]), _message(F.lit("assistant"), p["assistant"])
            ),
        )
    )
    kept = F.filter(turns, lambda m: (m["role"] == "user") | (truthy(m["content"]) != ""))
    new = F.array(_message(F.lit("user"), F.col(message)))
    return df.select(*keys, F.concat(kept, new).alias("messages"))


def non_blank(df: DataFrame, column: str) -> DataFrame:
    """Drop rows whose text is only white space."""
    return df.where(strip(column) != "")


def prompt_messages(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """A prompt text as a one-message list."""
    return df.select(*keys, F.array(_message(F.lit("user"), F.col(column))).alias("messages"))
