"""Arrays inside a row, in time linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def numbered(tokens: Column) -> Column:
    """Each token with its number among the equal ones before it, so that equal tokens differ."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        count = lambda b, k: F.coalesce(F.get(b, k + 1), F.size(s))
        one = lambda b: F.transform(b, lambda at, k: F.transform(F.sequence(F.lit(1), count(b, k) - at), lambda j: F.concat_ws(" ", F.get(s, at), j.cast("string"))))
        return let(begins, lambda b: F.flatten(one(b)))

    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(let(F.array_sort(tokens), runs))


def overlap(a: Column, b: Column) -> Column:
    """The size of the multiset intersection of two arrays of tokens."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))
