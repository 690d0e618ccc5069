"""Problem 3: bring text that looks the same to one form.

Method: values go through the look-alike map (width, invisible characters, blanks, letters and
signs of one shape) and are grouped in SQL under the accent-sensitive collation ``UNICODE``, which
takes composed and separate accents for the same. The smallest member of each class is its
canonical form, joined back to the rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.functions.unify import EXPANSIONS, INVISIBLE, MARKS, accent_pairs, look_pairs, same_look
from leadlens.session import materialise

COLLATION = "UNICODE"


@functools.cache
def _coarse() -> tuple[str, str]:
    """A translation that is coarser than the look: accents go, and so do all characters of expansions."""
    seen, meant = look_pairs()
    table = dict(zip(seen, meant))
    accented, plain = accent_pairs()
    bare = dict(zip(accented, plain))
    table = {c: bare.get(m, m) for c, m in table.items()} | {c: p for c, p in bare.items() if c not in table}
    table |= {chr(b): " " for b in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(9, 14))}
    dropped = {c for pair in EXPANSIONS.items() for part in pair for c in part}
    kept = {c: m for c, m in table.items() if c not in dropped and m not in dropped}
    gone = dropped | {c for c, m in table.items() if m in dropped}
    return "".join([*kept, *sorted(gone)]), "".join(kept.values())


def long_form(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(field, id, value, near, own)``: one row per row and field with a character.

    Values of one look have one ``near``, a hash that others may share; ``own`` is a hash of the value.
    """
    parts = [rows.select(F.lit(f).alias("field"), F.col(key).alias("id"), F.col(f).cast("string").alias("value")) for f in fields]
    out = functools.reduce(lambda a, b: a.unionByName(b), parts).where("value <> ''")
    seen, meant = _coarse()
    bare = F.translate(F.regexp_replace("value", f"[{INVISIBLE[1:-1]}{MARKS[1:-1]}]", ""), seen, meant)
    return out.withColumns({"near": F.xxhash64(F.trim(bare)), "own": F.xxhash64("value")})


def shared(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(field, id, value, look)`` of the values that may share their look with another string.

    One pass aggregates hashes map-side, so that only few values reach the collation.
    """
    long = long_form(rows, key, fields)
    several = long.groupBy("field", "near").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b")
    few = long.join(several, ["field", "near"], "left_semi").withColumn("look", F.trim(same_look(F.col("value")))).where("look <> ''")
    few = materialise(few.select("field", "id", "value", "look"), "looks")
    return few.withColumn("look", F.collate("look", COLLATION))


def classes(long: DataFrame) -> DataFrame:
    """``(field, look, canonical)`` of every class with at least two different members."""
    spark = long.sparkSession
    return spark.sql(
        """
        select field, look, min(value) as canonical from {long}
        group by field, look having min(value) <> max(value)
        """,
        long=long,
    )


def members(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(field, id, value, canonical)`` for the rows in classes with at least two different members."""
    long = shared(rows, key, fields)
    found = classes(long)
    spark = rows.sparkSession
    return spark.sql(
        "select l.field, l.id, l.value, c.canonical from {long} l join {found} c on l.field = c.field and l.look = c.look",
        long=long,
        found=found,
    )


def unified(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(field, id, value, canonical)`` for every row and field: its class's canonical form, else itself.

    Null, empty and invisible values are in no class and stay as they are; ids should be unique.
    """
    found = members(rows, key, fields).select("field", "id", "canonical")
    long = functools.reduce(
        lambda a, b: a.unionByName(b), [rows.select(F.lit(f).alias("field"), F.col(key).alias("id"), F.col(f).cast("string").alias("value")) for f in fields]
    )
    return long.join(found, ["field", "id"], "left").withColumn("canonical", F.coalesce("canonical", "value"))


def pairs(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(field, a, b)``: rows of the same look with different strings, ``a < b``.

    Every pair joined is a result; rows with equal strings are not compared. Classes with one
    member are gone before the join.
    """
    found = materialise(members(rows, key, fields), "members")
    left = found.select("field", "canonical", F.col("value").alias("va"), F.col("id").alias("a"))
    right = found.select("field", "canonical", F.col("value").alias("vb"), F.col("id").alias("b"))
    return left.join(right, ["field", "canonical"]).where("va <> vb and a < b").select("field", "a", "b")
