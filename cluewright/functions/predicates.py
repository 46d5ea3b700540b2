"""Column predicates of the scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_amount(amount: Column, modulus: int = 10000) -> Column:
    """The amount, rounded half to even, is a multiple of modulus. Null amounts give null."""
    return F.rint(amount.cast("double")).cast("long") % modulus == 0


def whole_hit(amount: Column, modulus: int = 10000) -> Column:
    """Like round_amount, but on the truncated number; what is null or no number is false."""
    return F.coalesce(amount.cast("string").try_cast("double").try_cast("long") % modulus == 0, F.lit(False))


def contains_any(column: Column, needles: list[str]) -> Column:
    """Any needle is a substring; null never is."""
    return F.coalesce(reduce(lambda a, b: a | b, [column.contains(n) for n in needles], F.lit(False)), F.lit(False))


def either_contains(a: Column, b: Column) -> Column:
    return (a == b) | a.contains(b) | b.contains(a)


def without_note(column: Column) -> Column:
    """Text before the first full-width parenthesis, trimmed."""
    return F.trim(F.substring_index(column, "（", 1))


def filled(column: Column) -> Column:
    return column.isNotNull() & (F.trim(column) != "")
