"""Problem 1: cap the rows of every contributor of a batch, keeping the best-scored ones.

Method: mergeable bounded heaps, keyed by (batch, contributor), built map-side and merged in a tree;
the worst score-identifier pair that a contributor's heap keeps is the mark by which the full records
are joined. The cap is a share of the batch, so a heap of the whole cap would grow with the data.
Ranges of scores are therefore counted first, map-side: only in the range in which the cap falls does
it matter which rows are best. That range is cut into finer ones, then into equal scores and blocks
of ordinals, until a heap of at most ``BLOCK`` pairs decides. The number of ranges per contributor is
fixed, so no contributor's rows are ever sorted or held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens.session import materialise, release

#: Ordinals per block, and so the largest heap.
BLOCK = 1 << 16
#: Score ranges per factor of two in the first cut, and ranges in the second.
OCTAVE, FINE = 64, 1 << 16
#: Partial heaps that one task merges.
FAN_IN = 16
#: Range of rows without a score: behind all others.
_NO_SCORE = 1 << 40
_KEY = ["_g", "_c"]


def score_range(score: Column) -> Column:
    """A bigint that rises as the score falls, ``OCTAVE`` values per factor of two; null for a null score."""
    size = (F.floor(F.least(F.log2(F.abs(score)), F.lit(1100.0)) * OCTAVE) + F.lit(1 << 20)).cast("long")
    return F.when(score > 0, -size).when(score < 0, size).when(score == 0, F.lit(0).cast("long"))


def _cut(counts: DataFrame, order: list[str]) -> DataFrame:
    """Of each contributor the cell of ``counts`` in which its room ends, with the room left in it; none where all fit."""
    before = F.sum("_n").over(Window.partitionBy(*_KEY).orderBy(*order)) - F.col("_n")
    return counts.withColumn("_left", F.col("_room") - before).where("_left >= 0 and _left < _n")


def _of(left: DataFrame, right: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """A join by batch, which may be null, contributor and ``more``."""
    renamed = right.withColumnsRenamed({c: f"_r{c}" for c in [*_KEY, *more]})
    same = F.col("_g").eqNullSafe(F.col("_r_g")) & (F.col("_c") == F.col("_r_c"))
    for c in more:
        same &= F.col(c).eqNullSafe(F.col(f"_r{c}"))
    return left.join(renamed, same, how).drop(*[f"_r{c}" for c in [*_KEY, *more]])


def _best(pdf: pd.DataFrame) -> pd.DataFrame:
    """The heap of each contributor: the smallest ordinals, as many as it has room for."""
    pdf = pdf.sort_values("_i", kind="stable")
    rank = pdf.groupby(_KEY, sort=False, dropna=False).cumcount()
    return pdf[rank.to_numpy() < pdf["_left"].to_numpy()]


def _map_side(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    size, limit, part = 0, 1 << 17, 0
    for pdf in batches:
        part = part or int(pdf["_i"].iloc[0]) % FAN_IN if len(pdf) else part
        held.append(pdf)
        size += len(pdf)
        if size > limit:
            held = [_best(pd.concat(held))]
            size = len(held[0])
            limit = max(1 << 17, 2 * size)
    if held:
        yield _best(pd.concat(held)).assign(_part=np.int32(part))


def marks(rows: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """``(_g, _c, _worst, _last)``: of every contributor beyond its cap the worst pair it keeps; and what to release afterwards.

    ``rows`` holds ``_g`` (batch), ``_c`` (contributor), ``_score`` (double, no NaN) and ``_i`` (identifier).
    """
    spread = rows.withColumn("_range", F.coalesce(score_range(F.col("_score")), F.lit(_NO_SCORE)))
    counts = spread.groupBy(*_KEY, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_score").alias("_low"), F.max("_score").alias("_high"))
    caps = counts.groupBy("_g").agg(F.floor(F.sum("_n") / F.lit(share)).alias("_room")).withColumnRenamed("_g", "_b")
    known = counts.where("_c is not null").join(caps, F.col("_g").eqNullSafe(F.col("_b"))).drop("_b")
    first = _cut(known, ["_range"]).select(*_KEY, "_range", F.col("_left").alias("_room"), "_low", "_high")
    inside = _of(spread.where("_c is not null"), first, "_range")
    # a range of one score is not cut further; its places are 0
    place = F.floor((F.col("_high") - F.col("_score")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * FINE)
    inside = materialise(inside.withColumn("_place", F.coalesce(place, F.lit(0))).select(*_KEY, "_score", "_i", "_place", "_room"), "inside")
    second = _cut(inside.groupBy(*_KEY, "_place", "_room").agg(F.count(F.lit(1)).alias("_n")), ["_place"])
    narrow = _of(inside.drop("_room"), second.select(*_KEY, "_place", F.col("_left").alias("_room")), "_place")
    narrow = narrow.withColumns({"_block": F.floor(F.col("_i") / F.lit(BLOCK)), "_minus": -F.col("_score")})
    cells = narrow.groupBy(*_KEY, "_score", "_minus", "_block", "_room").agg(F.count(F.lit(1)).alias("_n"))
    last = _cut(cells.withColumn("_none", F.col("_score").isNull()), ["_none", "_minus", "_block"]).select(*_KEY, "_score", "_block", "_left")

    cut = _of(narrow.select(*_KEY, "_score", "_i", "_block"), last, "_score", "_block").where("_left > 0").select(*_KEY, "_i", "_left")
    schema = cut.schema
    partial = cut.mapInPandas(_map_side, schema.simpleString()[7:-1] + ", _part int")
    merged = partial.groupBy(*_KEY, "_part").applyInPandas(lambda p: _best(p.drop(columns="_part")), schema)
    heap = merged.groupBy(*_KEY).applyInPandas(_best, schema).groupBy(*_KEY).agg(F.max("_i").alias("_last"))
    end = F.col("_block") * F.lit(BLOCK) - 1  # of the blocks before, where this one has no room
    found = _of(last.select(*_KEY, "_score", "_block"), heap, how="left")
    return found.select(*_KEY, F.col("_score").alias("_worst"), F.coalesce("_last", end).alias("_last")), inside


def capped(rows: DataFrame, batch: str, contributor: str, score: str, identifier: str, share: int = 20) -> DataFrame:
    """``rows`` with a boolean column ``kept``.

    In each ``batch`` a ``contributor`` keeps at most ``floor(rows of the batch / share)`` rows:
    highest ``score`` first, null and NaN last, then the smallest ``identifier`` (an integer that
    rises with the input). Rows of a null contributor count as rows of the batch and are kept; a
    null batch is a batch of its own. Rows with one identifier, batch, contributor and score share
    one verdict. An empty table gives an empty result. Other columns, whatever their names, come
    through unchanged; a column ``kept`` is replaced. ``rows`` is read three times.
    """
    number = F.col(f"`{score}`").cast("double")
    keyed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "kept"]).alias("_all"),
        F.col(f"`{batch}`").alias("_g"), F.col(f"`{contributor}`").alias("_c"), F.when(~F.isnan(number), number).alias("_score"), F.col(f"`{identifier}`").cast("long").alias("_i"),
    )
    found, inside = marks(keyed.drop("_all"), share)
    found = materialise(found.withColumn("_over", F.lit(True)), "marks")
    release(inside)
    better = F.coalesce(F.col("_score") > F.col("_worst"), F.col("_score").isNotNull() & F.col("_worst").isNull())
    level = F.col("_score").eqNullSafe(F.col("_worst")) & (F.col("_i") <= F.col("_last"))
    return _of(keyed, found, how="left").select("_all.*", (F.col("_over").isNull() | better | level).alias("kept"))
