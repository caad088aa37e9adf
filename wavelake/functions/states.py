"""Values of simulator words as states: two bit planes make 0, 1, X and Z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def states(low: Column, high: Column, width: int, swapped: bool = False) -> Column:
    """A string of states, highest bit first, of two planes (longs, at most 63 bits): 0 and 1 where the high plane has 0, else Z and X by the low plane. `swapped` is the other convention for these two, which some captured files have."""
    bits = F.sequence(F.lit(width - 1), F.lit(0))
    one, two = ("X", "Z") if swapped else ("Z", "X")

    def at(i: Column) -> Column:
        a, b = (F.shiftright(c.cast("long"), 0).bitwiseAND(_bit(i)) != 0 for c in (low, high))
        return F.when(~b, F.when(a, "1").otherwise("0")).otherwise(F.when(a, two).otherwise(one))

    return F.array_join(F.transform(bits, at), "")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def number(text: Column) -> Column:
    """The long that a string of 0 and 1 is; null with other states."""
    return F.when(text.rlike("^[01]{1,63}$"), F.conv(text, 2, 10).cast("long"))


def wide(words: Column, width: int) -> Column:
    """Big-endian bytes of a two-state value given as an array of 32-bit words, lowest first; null words are 0."""
    whole = F.array_join(F.transform(F.reverse(words), lambda w: F.lpad(F.hex(F.coalesce(w, F.lit(0)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")
    size = 2 * ((width + 7) // 8)
    return F.unhex(F.right(F.concat(F.lit("0" * size), whole), F.lit(size)))
