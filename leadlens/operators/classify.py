"""Classification by keyword tables and ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlens.functions.values import hits


def most_hits(text: Column, keywords: dict[str, list[str]]) -> Column:
    """The class with most keywords in the text; the first of equal ones, null without a hit."""
    scored = [F.struct(hits(text, words).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("c")) for i, (name, words) in enumerate(keywords.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["c"])


def first_rule(text: Column, rules: list[tuple[str, list[str], list[str]]]) -> Column:
    """The class of the first rule with one of its words and none of its excluded ones in the text."""
    out = F.lit(None).cast("string")
    for name, words, excluded in reversed(rules):
        met = hits(text, words) > 0
        if excluded:
            met &= hits(text, excluded) == 0
        out = F.when(met, name).otherwise(out)
    return out


def first_pattern(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The class of the first pattern that the lower-case text matches."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(p), name) for name, p in patterns])


def labels(text: Column, words: dict[str, list[str]], most: int, default: str) -> Column:
    """All classes with a hit, at most ``most`` in the table's order; the default if there is none."""
    found = F.slice(F.array_compact(F.array(*[F.when(hits(text, w) > 0, name) for name, w in words.items()])), 1, most)
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def source_quality(tier: Column, group: Column, named: Column, kind: Column) -> Column:
    """Quality of a source: its own tier, else by its group, else what is known by its name, else by its type."""
    own, among = F.lower(F.trim(tier)), F.lower(group)
    by_type = F.when(kind.isin("verified_official", "editorial_source", "packaging_source"), "premium").when(kind == "trend_source", "weak").otherwise("standard")
    by_group = F.when(F.contains(among, F.lit("weak")), "weak").when(F.contains(among, F.lit("strong")), "standard")
    return F.coalesce(F.when(own.isin("premium", "standard", "weak"), own), by_group, named, by_type)


def source_family(kind: Column, quality: Column) -> Column:
    """Family of a source by type and quality."""
    simple = {"social_signal": "social", "verified_official": "award", "editorial_source": "media", "packaging_source": "packaging", "design_community": "community"}
    out = F.when((kind == "market_reference") | (kind == "trend_source"), F.when(quality == "weak", "weak market").when(kind == "trend_source", "trend").otherwise("market"))
    for name, family in simple.items():
        out = out.when(kind == name, family)
    return out.otherwise("other")
