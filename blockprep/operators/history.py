"""Chat history in front of every user turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprep.functions.text import strip
from blockprep.operators.running import running_counts_with_reset

# The two commands of a chat, compared in lower case.
CLEAR_COMMAND = "clear"
EXIT_COMMAND = "exit"


def history_messages(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """The messages a chat keeps: (key, epoch, turn, ord, role, content, is_prompt).

    A clear command starts a new epoch, an exit command ends the conversation;
    commands and blank user texts are no messages.  The prompt of a user turn
    is the epoch's messages 0 .. ``ord``: a prefix, named by its end instead
    of being copied out per turn, so the table grows with the turns and not
    with their square.
    """
    text = strip(F.coalesce("text", F.lit("")))
    is_user = F.col("role") == "user"
    command = F.lower(text)
    is_clear = is_user & (command == CLEAR_COMMAND)
    marked = turns.select(
        key,
        "turn",
        "role",
        text.alias("content"),
        is_clear.alias("is_clear"),
        (is_user & (command == EXIT_COMMAND)).alias("is_exit"),
        (~is_clear & ~(is_user & (text == ""))).alias("is_message"),
    )
    counted = running_counts_with_reset(
        marked,
        [key],
        "turn",
        {"epoch": F.col("is_clear").cast("int"), "exits": F.col("is_exit").cast("int")},
        "messages",
        F.col("is_message"),
        F.col("is_clear"),
    )
    return counted.where((F.col("exits") == 0) & F.col("is_message")).select(
        key,
        "epoch",
        "turn",
        (F.col("messages") - 1).alias("ord"),
        "role",
        "content",
        (F.col("role") == "user").alias("is_prompt"),
    )


def history_prompts(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per user turn: (key, turn, epoch, n_messages, prompt).

    The whole prompt is the first ``n_messages`` rows of that epoch in
    ``history_messages``; ``prompt`` is the last of them, the new user text.
    """
    return history_messages(turns, key).where("is_prompt").select(
        key, "turn", "epoch", (F.col("ord") + 1).alias("n_messages"), F.col("content").alias("prompt")
    )


def epoch_messages(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """History as message rows with one sample per epoch, for rendering and tokenizing."""
    return history_messages(turns, key).select(
        F.concat_ws(":", F.col(key).cast("string"), F.col("epoch").cast("string")).alias("sample_id"),
        "ord",
        "role",
        "content",
    )
