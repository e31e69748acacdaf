"""Seeded, placement-independent randomness from hashes.

``rand(seed)`` depends on how rows are spread over partitions; a hash of the
row's own key does not, so every result here repeats under repartitioning and
after a lost executor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Positions whose coins come out of one hash.
WORD_BITS = 32

# Rounds of a permutation, hex digits of a round's hash, and the most rows of its grid.
ROUNDS, ROUND_DIGITS, MOST_ROWS = 6, 15, 4096


def hash_key(*parts: Column | str | int) -> Column:
    """MD5, in hex, of the parts joined by colons; plain values are literals."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def hash_word(*parts: Column | str | int) -> Column:
    """The first 32 bits of the hash as a long."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the hash."""
    return hash_word(*parts) / F.lit(float(2**32))


def coin_array(length: int | Column, *parts: Column | str | int) -> Column:
    """One fair coin (0/1) per position: bit ``pos % 32`` of word ``pos div 32``.

    The words are the argument of the outer ``transform``, so that each hash
    is computed once and not again for every bit.
    """
    length = F.lit(length) if isinstance(length, int) else length
    last_word = F.floor((length - 1) / F.lit(WORD_BITS)).cast("int")
    numbers = F.when(length > 0, F.sequence(F.lit(0), last_word)).otherwise(
        F.array().cast("array<int>")
    )
    words = F.transform(numbers, lambda w: hash_word(*parts, w))
    bits = F.flatten(
        F.transform(
            words,
            lambda word: F.array(
                *[F.shiftright(word, j).bitwiseAND(F.lit(1)).cast("int") for j in range(WORD_BITS)]
            ),
        )
    )
    return F.slice(bits, F.lit(1), length)


def grid_of(n: int) -> tuple[int, int]:
    """Rows and columns of the grid that a permutation of ``n`` numbers works on: a * b >= n."""
    rows = 1
    while rows < MOST_ROWS and rows * rows < n:
        rows *= 2
    return rows, -(-n // rows)


def permuted(number: Column, n: int, *parts: Column | str | int) -> Column:
    """A seeded bijection of 0 .. n - 1, computed from the number alone.

    The numbers lie in a grid of a rows and b columns.  In turn the column is moved on by a
    hash of the row and the row by a hash of the column (a Feistel network), which can be undone
    and so is a bijection of the grid.  The grid has fewer than a places beyond n; a number that
    lands there goes on until it comes back, which takes no more rounds than there are such places.
    """
    a, b = grid_of(n)

    def shift(round_: int, half: Column, size: int) -> Column:
        digits = F.substring(hash_key(*parts, round_, half), 1, ROUND_DIGITS)
        return F.conv(digits, 16, 10).cast("long") % size

    def moved(round_: int) -> Callable[[Column], Column]:
        if round_ % 2 == 0:
            return lambda p: F.struct(p["r"], ((p["c"] + shift(round_, p["r"], b)) % b).alias("c"))
        return lambda p: F.struct(((p["r"] + shift(round_, p["c"], a)) % a).alias("r"), p["c"])

    def once(at: Column) -> Column:
        # A transform of one element each, so that a round's value is computed once.
        place = F.array(F.struct((at % a).alias("r"), F.floor(at / a).cast("long").alias("c")))
        for round_ in range(ROUNDS):
            place = F.transform(place, moved(round_))
        return F.element_at(F.transform(place, lambda p: p["c"] * a + p["r"]), 1)

    first = once(number.cast("long"))
    spare = a * b - n
    if not spare:
        return first

    def back(at: Column) -> Column:
        tries = F.sequence(F.lit(1), F.lit(spare))
        return F.when(at < n, at).otherwise(F.aggregate(tries, at, lambda x, _: F.when(x < n, x).otherwise(once(x))))

    return F.element_at(F.transform(F.array(first), back), 1)
