"""Array functions that SQL has no name for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one inner fold puts together; time grows with the list's length times this.
BLOCK = 128


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once."""
    return F.transform(F.array(value), f)[0]


def with_starts(items: Column, width: Callable[[Column], Column], make: Callable[[Column, Column], Column], row: str) -> Column:
    """Array of ``make(start, item)``, of type ``row``; an item's start is the sum of the widths before it."""
    return running(items, width, lambda a, n: a + n, make, row)


def running(
    items: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], make: Callable[[Column, Column], Column], row: str
) -> Column:
    """Array of ``make(before, item)``, of type ``row``; before combines 0 and the values of all items before it.

    A fold that grows one long array copies it for each element; here folds run over short blocks, whose values are combined first,
    so ``combine`` must be associative.
    """
    empty = lambda kind: F.array().cast(f"array<{kind}>")

    def blocks(all_: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(all_, j * BLOCK + 1, F.lit(BLOCK)))

    def starts(parts: Column) -> Column:
        sums = F.transform(parts, lambda b: F.aggregate(b, F.lit(0), lambda a, x: combine(a, value(x))))
        first = F.struct(F.lit(0).alias("at"), empty("int").alias("out"))
        step = lambda s, n: F.struct(combine(s["at"], n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(sums, first, step, lambda s: s["out"])

    def fold(z: Column) -> Column:
        first = F.struct(z["s"].alias("at"), empty(row).alias("out"))
        step = lambda s, x: F.struct(combine(s["at"], value(x)).alias("at"), F.concat(s["out"], F.array(make(s["at"], x))).alias("out"))
        return F.aggregate(z["b"], first, step, lambda s: s["out"])

    laid = lambda parts: F.flatten(F.transform(F.arrays_zip(parts.alias("b"), starts(parts).alias("s")), fold))
    return bound(items, lambda all_: bound(blocks(all_), laid))


#: Characters of a text's pieces.
PIECE = 1024


def pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, of which ``cut`` takes parts."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` (from 0) of a text in ``pieces``; its time doesn't grow with the text, as substring's does."""
    end = start + length - 1
    i, j = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    head = F.substring(F.get(parts, i), (start % PIECE + 1).cast("int"), F.when(i == j, length).otherwise(F.lit(PIECE)).cast("int"))
    middle = F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    tail = F.substring(F.get(parts, j), F.lit(1), (end % PIECE + 1).cast("int"))
    return F.when(length <= 0, "").when(i == j, head).otherwise(F.concat(head, middle, tail))
