"""Keep-first, latest, ranking, interleaving, rotation and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``. Aggregated map-side, so a hot key is no hot task; ``order`` must be total."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*key).agg(F.min_by(whole, rank).alias("_row")).select("_row.*")


def keep_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by ``order``."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*key).agg(F.max_by(whole, rank).alias("_row")).select("_row.*")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each map task to k rows of a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def round_robin(df: DataFrame, bucket: str, order: list[Column], bucket_order: Column, position: str = "position") -> DataFrame:
    """Rows with a position that takes one row of each bucket in turn."""
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return df.withColumn("_turn", turn).withColumn("_place", bucket_order).withColumn(position, F.struct("_turn", "_place")).drop("_turn", "_place")


def rotated(ordinal: Column, offset: int, n: int) -> Column:
    """The place of an ordinal in a ring of ``n`` that begins at ``offset``."""
    return F.pmod(ordinal - F.lit(offset), F.lit(n))


def rate_limited(df: DataFrame, actor: str, at: str, order: list[Column], limit: int, seconds: int = 86_400) -> DataFrame:
    """Rows within the first ``limit`` of their actor and period."""
    period = F.floor(F.unix_timestamp(at) / seconds)
    return top_k(df.withColumn("_period", period), [actor, "_period"], order, limit, "_nth").drop("_period", "_nth")


def within_budget(df: DataFrame, period: Column, order: list[Column], amount: str, calls: int, most: float) -> DataFrame:
    """Rows of each period until its calls or the sum of its amounts are used up: a row passes while both are below before it.

    What follows a refused row is refused too, so the rows are the first of their period. At most ``calls`` rows of a
    period are ever summed.
    """
    first = top_k(df.withColumn("_period", period), ["_period"], order, calls, "_nth")
    before = Window.partitionBy("_period").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("_spent", F.coalesce(F.sum(amount).over(before), F.lit(0))).where(F.col("_spent") < most).drop("_period", "_nth", "_spent")
