"""Bitmaps as 64-bit words: where a number's bit is, and changes of a word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE, EVERY = 0, -1


def constant(word: int) -> Column:
    return F.lit(word).cast("bigint")


def word_of(number: Column) -> Column:
    return F.shiftright(number, 6)


def bit_of(number: Column) -> Column:
    return F.call_function("shiftleft", constant(1), (number % 64).cast("int"))


def has_bit(word: Column, number: Column) -> Column:
    return F.getbit(word, (number % 64).cast("int")) == 1


def changed(word: Column, change: Column) -> Column:
    """A word after a change ``(added, bits)``: bits set, or bits cleared."""
    return F.when(change["added"], word.bitwiseOR(change["bits"])).otherwise(word.bitwiseAND(F.bitwise_not(change["bits"])))
