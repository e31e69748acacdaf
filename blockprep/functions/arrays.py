"""Expressions on token id arrays and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockprep.config import INVISIBLE
from blockprep.functions.text import _as_column


def truncate(ids: Column | str, length: int) -> Column:
    return F.slice(_as_column(ids), 1, length)


def append_eos(ids: Column | str, eos_id: int | None) -> Column:
    """Add the end-of-sequence id unless the list already ends in it."""
    ids = _as_column(ids)
    if eos_id is None:
        return ids
    last = F.try_element_at(ids, F.lit(-1))
    return F.when(last.eqNullSafe(F.lit(eos_id)), ids).otherwise(
        F.concat(ids, F.array(F.lit(eos_id).cast("int")))
    )


def pad_block(ids: Column | str, block_size: int, mask_id: int) -> Column:
    """Fill up to the next block border with the mask id."""
    ids = _as_column(ids)
    missing = F.pmod(-F.size(ids), F.lit(block_size))
    return F.concat(ids, F.array_repeat(F.lit(mask_id).cast("int"), missing))


def fit_context(ids: Column | str, length: int, mask_id: int) -> Column:
    """Cut or fill with the mask id to exactly ``length``."""
    ids = _as_column(ids)
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(ids))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(mask_id).cast("int"), missing)), 1, length)


def block_of(pos: Column | str, block_size: int) -> Column:
    """Number of the block that holds a position."""
    return F.floor(_as_column(pos) / F.lit(block_size)).cast("int")


def visible_upto(pos: Column | str, length: int | Column, block_size: int) -> Column:
    """Block-causal visibility: a query sees exactly the keys below this bound."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.least(length, (block_of(pos, block_size) + 1) * F.lit(block_size)).cast("int")


def prefix_visible_upto(pos: Column | str, length: int | Column, current_block: int | Column) -> Column:
    """Filling-time visibility: causal prefix, and all of the current block."""
    pos = _as_column(pos)
    length = F.lit(length) if isinstance(length, int) else length
    current_block = F.lit(current_block) if isinstance(current_block, int) else current_block
    return F.when(pos >= length - current_block, length).otherwise(pos + 1).cast("int")


def additive_value(key_pos: Column | str, upto: Column | str) -> Column:
    """What a key adds to its attention score: nothing, or the invisible value."""
    return F.when(_as_column(key_pos) < _as_column(upto), F.lit(0.0)).otherwise(F.lit(INVISIBLE))
