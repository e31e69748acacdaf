"""String expressions: coalescing, roles, stripping, rendering, splitting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockprep.config import EOS_TOKEN, TURN_END, TURN_START, PrepConfig

# The characters removed from both ends of a text (Unicode
# white space), written so that Java and RE2 read the class alike.
STRIP_CLASS = (
    r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
STRIP_PATTERN = rf"^{STRIP_CLASS}+|{STRIP_CLASS}+\z"

# A run of letters, digits or blanks is cut into pieces of this many
# characters, so that no token, and so no vocabulary row, is unbounded.
RUN_LENGTH = 32


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def truthy(*columns: Column | str) -> Column:
    """First value that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(_as_column(c), F.lit("")) for c in columns], F.lit(""))


def norm_role(column: Column | str) -> Column:
    """Map the role names of list-shaped rows to user / assistant / system."""
    role = _as_column(column)
    return (
        F.when(role.isin("human", "user"), "user")
        .when(role.isin("gpt", "assistant"), "assistant")
        .otherwise("system")
    )


def user_text(instruction: Column | str, extra: Column | str) -> Column:
    """The instruction, followed by the extra input when there is one."""
    instruction, extra = _as_column(instruction), _as_column(extra)
    return F.when(extra == "", instruction).otherwise(F.concat(instruction, F.lit("\n\n"), extra))


def strip(column: Column | str) -> Column:
    """Remove white space (not only blanks) from both ends."""
    return F.regexp_replace(_as_column(column), STRIP_PATTERN, "")


def render_message(role: Column | str, content: Column | str) -> Column:
    """One message as chat text."""
    return F.concat(
        F.lit(TURN_START), _as_column(role), F.lit("\n"), _as_column(content), F.lit(f"{TURN_END}\n")
    )


def generation_prompt() -> Column:
    """The open assistant turn that asks for an answer."""
    return F.lit(f"{TURN_START}assistant\n")


def render_chat(messages: Column | str, add_generation_prompt: bool = False) -> Column:
    """A message list as chat text."""
    text = F.array_join(
        F.transform(_as_column(messages), lambda m: render_message(m["role"], m["content"])), ""
    )
    return F.concat(text, generation_prompt()) if add_generation_prompt else text


def token_pattern(cfg: PrepConfig = PrepConfig()) -> str:
    """Lossless split: marks first, then letter, digit, single and blank runs.

    The first characters of the marks are kept out of the "any other
    character" branch, which may take a blank along: a mark is therefore
    found wherever it stands, and rendered messages split independently of
    their neighbours.
    """
    marks = [TURN_START, TURN_END, EOS_TOKEN, cfg.mask_token]
    heads = "".join(sorted({re.escape(mark[0]) for mark in marks}))
    branches = [re.escape(mark) for mark in marks] + [
        rf" ?\p{{L}}{{1,{RUN_LENGTH}}}",
        rf" ?\p{{N}}{{1,{RUN_LENGTH}}}",
        rf" ?[^ \t\n\f\r{heads}\p{{L}}\p{{N}}]",
        rf"[{heads}]",
        rf"[ \t\n\f\r]{{1,{RUN_LENGTH}}}",
    ]
    return "(" + "|".join(branches) + ")"


def split_tokens(text: Column | str, cfg: PrepConfig = PrepConfig()) -> Column:
    """The tokens of a text; joined without a separator they give it back."""
    return F.regexp_extract_all(_as_column(text), F.lit(token_pattern(cfg)), F.lit(1))
