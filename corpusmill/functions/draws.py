"""Deterministic draws: the same record gets the same value on any number of partitions.

A draw is 32 bits of an MD5 digest over seed, record and purpose.  One digest serves four slots.
"""

from __future__ import annotations

from copy import copy
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class Draws:
    """Draws for one record and one field; ``slot`` tells the draws of a value apart."""

    def __init__(self, seed: int, record: Column, field: Column):
        self._prefix = F.concat_ws(":", F.lit(str(seed)), record.cast("string"), field)
        self._held: list[Column] = []

    def digest(self, block: int | Column) -> Column:
        block = F.lit(block) if isinstance(block, int) else block
        return F.md5(F.concat_ws(":", self._prefix, block.cast("string")))

    def holding(self, *digests: Column) -> Draws:
        """The same draws, taking the digests of the first blocks from columns."""
        other = copy(self)
        other._held = list(digests)
        return other

    def bits(self, slot: int) -> Column:
        block = slot // 4
        digest = self._held[block] if block < len(self._held) else self.digest(block)
        return _number(digest, F.lit(slot % 4))

    def between(self, slot: int, low: int | Column, high: int | Column) -> Column:
        """Whole number in [low, high]."""
        low = F.lit(low) if isinstance(low, int) else low
        return (low + F.pmod(self.bits(slot), high - low + 1)).cast("bigint")

    def pick(self, slot: int, pool: Sequence[str] | Column) -> Column:
        """One entry of a pool, given as values or as a non-empty array column."""
        return entry_of(pool, self.bits(slot))

    def many(self, first: int, last: Column, value: Callable[[Column], Column]) -> Column:
        """``value`` of the draws in slots ``first`` to ``last``, as an array.

        The digests are held in a lambda variable, so each is computed once for its four slots.
        """
        blocks = F.sequence(F.lit(first // 4).cast("bigint"), F.floor(last / 4).cast("bigint"))
        slots = F.sequence(F.lit(first).cast("bigint"), last.cast("bigint"))

        def draw(digests: Column, slot: Column) -> Column:
            digest = F.get(digests, (F.floor(slot / 4) - first // 4).cast("int"))
            return value(_number(digest, F.pmod(slot, F.lit(4))))

        held = F.transform(F.array(F.transform(blocks, self.digest)), lambda ds: F.transform(slots, lambda i: draw(ds, i)))
        return F.get(held, F.lit(0))


def _number(digest: Column, quarter: Column) -> Column:
    part = F.substring(digest, (quarter * 8 + 1).cast("int"), F.lit(8))
    return F.conv(part, 16, 10).cast("bigint")


def entry_of(pool: Sequence[str] | Column, bits: Column) -> Column:
    if isinstance(pool, Column):
        return F.get(pool, F.pmod(bits, F.size(pool)).cast("int"))
    return F.get(constant_array(pool), F.pmod(bits, F.lit(len(pool))).cast("int"))


def constant_array(values: Sequence[str]) -> Column:
    """Array of texts from one literal (folded to a constant; far fewer calls than one per value)."""
    return F.split(F.lit("\x1f".join(values)), "\x1f", -1)
