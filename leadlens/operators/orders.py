"""Orders with a limit, and the order of search jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, order: list[Column], limit: int, place: str = "place") -> DataFrame:
    """The first ``limit`` rows of a total order with their place; every task keeps ``limit`` rows before they meet."""
    first = rows.orderBy(*order).limit(limit)
    return first.withColumn(place, F.row_number().over(Window.orderBy(*order)).cast("long"))


def search_round(jobs: DataFrame, category: str, ordinal: Column, offset: int, priority: dict[str, int], caps: dict[str, int], limit: int) -> DataFrame:
    """Jobs of one round with ``place``: a ring that begins at ``offset``, categories of a priority first, some capped.

    ``ordinal`` numbers the jobs from 0; they are the product of small dimensions.
    """
    rank = F.coalesce(*[F.when(F.col(category) == c, p) for c, p in priority.items()], F.lit(max(priority.values(), default=0) + 1))
    turned = jobs.withColumn("_turn", F.pmod(ordinal - F.lit(offset), F.count(F.lit(1)).over(Window.partitionBy()))).withColumn("_rank", rank)
    turned = turned.withColumn("_nth", F.row_number().over(Window.partitionBy(category).orderBy("_rank", "_turn")))
    cap = F.coalesce(*[F.when(F.col(category) == c, n) for c, n in caps.items()], F.lit(1 << 30))
    return first_rows(turned.where(F.col("_nth") <= cap), [F.col("_rank"), F.col("_turn")], limit).drop("_turn", "_rank", "_nth")
