"""Arrays as short series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_n(arr: Column, n: int) -> Column:
    """The last n elements, or all if there are fewer."""
    return F.slice(arr, F.greatest(F.lit(1), F.size(arr) - n + 1), F.lit(n))


def from_last(arr: Column, start: int, end: int) -> Column:
    """Elements start to end (exclusive) counted from the last one, 0 being the last."""
    return F.slice(F.reverse(arr), start + 1, end - start)


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


def mean_or(arr: Column, fallback: float = 0.0) -> Column:
    held = F.filter(arr, lambda x: x.isNotNull())
    return F.when(F.size(held) > 0, total(held) / F.size(held)).otherwise(fallback)


def count_if(arr: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(arr, test))


def clamped_walk(arr: Column, start: Column, step: Callable[[Column, Column], Column], low: float, high: Column | float) -> Column:
    """Run through an array, clamping after each step; this can't be a sum over a window."""
    top = F.lit(high) if isinstance(high, (int, float)) else high
    return F.aggregate(arr, start.cast("double"), lambda state, x: F.greatest(F.lit(low), F.least(top, step(state, x))).cast("double"))


def codes(*rules: tuple[Column, str]) -> Column:
    """The codes of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(test, F.lit(code)) for test, code in rules)))


def strongest(parts: list[tuple[Column, Column, str]], n: int, otherwise: str) -> Column:
    """Texts of the n strongest parts (test, strength, text); ties keep their order."""
    held = F.array_compact(
        F.array(*(F.when(test, F.struct((-strength.cast("double")).alias("s"), F.lit(i).alias("i"), F.lit(text).alias("t"))) for i, (test, strength, text) in enumerate(parts)))
    )
    texts = F.transform(F.slice(F.array_sort(held), 1, n), lambda x: x["t"])
    return F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit(otherwise)))


def first_distinct(arr: Column, n: int) -> Column:
    """The first n different values that aren't null, in order."""
    return F.slice(F.array_distinct(F.array_compact(arr)), 1, n)
