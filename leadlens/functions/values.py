"""Defaults, clamps and rounding with the semantics of the data's origin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def nz(c: Column, default: str | Column = "") -> Column:
    """``c``, or ``default`` where it is null or empty."""
    other = default if isinstance(default, Column) else F.lit(default)
    return F.when(c.isNull() | (c == ""), other).otherwise(c)


def first_nonempty(*columns: Column) -> Column:
    """The first value that is neither null nor empty, else null."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def clamp(c: Column, low: int, high: int) -> Column:
    """Rounded half to even and kept within bounds; null counts as 0."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.bround(F.coalesce(c, F.lit(0))))).cast("int")


def weighted(terms: dict[Column, float] | list[tuple[Column, float]], rounded: bool = True) -> Column:
    """Weighted sum in the order given, nulls as 0; rounded half to even if asked."""
    pairs = terms.items() if isinstance(terms, dict) else terms
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) * F.lit(w) for c, w in pairs])
    return F.bround(total).cast("int") if rounded else total


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the text, each counted once per listing in ``words``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w.lower())).cast("int") for w in words])


def bucket(c: Column, edges: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first edge that the value reaches, from high to low."""
    out = F.when(c >= F.lit(edges[0][0]), edges[0][1])
    for edge, name in edges[1:]:
        out = out.when(c >= F.lit(edge), name)
    return out.otherwise(rest)


def iso_week(c: Column) -> Column:
    """ISO week of a date as ``2026-W34``."""
    return F.concat(
        F.date_part(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0")
    )


def week_range(c: Column) -> tuple[Column, Column]:
    """Monday and Sunday of a date's week."""
    monday = F.to_date(F.date_trunc("week", c))
    return monday, F.date_add(monday, 6)


def map_update(old: Column, new: Column) -> Column:
    """``old`` with the entries of ``new``, whose values win unless they are null."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at(new, k), F.try_element_at(old, k))))
