"""Counts, top counts and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, key: Column, name: str, ordinal: str) -> DataFrame:
    """``(name, n, first)``: counts by one key with the first ordinal, by which ties are ordered."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))


def count_exploded(df: DataFrame, array: Column, name: str, ordinal: str) -> DataFrame:
    """As ``count_by`` over the members of an array; null and empty arrays count nothing."""
    return count_by(df.select(F.explode(array).alias("_x"), ordinal), F.col("_x"), name, ordinal)


def most_common(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest counts, ties by first occurrence."""
    return counts.orderBy(F.desc("n"), F.asc("first")).limit(k)


def top_counts_by(df: DataFrame, group: str, field: str, ordinal: str, k: int) -> DataFrame:
    """The ``k`` commonest values of a field in each group."""
    counts = df.groupBy(group, field).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.asc("first")))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def quota_fill(df: DataFrame, key: str, quotas: DataFrame) -> DataFrame:
    """``(key, quota, filled)`` of every quota; zeros are kept."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return quotas.join(counts, key, "left").select(key, "quota", F.least(F.coalesce("_n", F.lit(0)), F.col("quota")).alias("filled"))


def first_seen(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """Earliest time per key over a state and new rows: an incremental minimum."""
    return old.select(key, at).unionByName(new.select(key, at)).groupBy(key).agg(F.min(at).alias(at))


def merged_products(rows: DataFrame, key: str) -> DataFrame:
    """One row per key from records of several sources: longest summary, highest score, sorted tags and the like."""
    return rows.groupBy(key).agg(
        F.count_distinct("url").alias("sources"),
        F.max_by("reason", F.struct(F.length("reason"), -F.col("ordinal"))).alias("summary"),
        F.max("score").alias("score"),
        F.sum(F.coalesce("likes", F.lit(0))).alias("likes"),
        F.min("added").alias("first_seen"),
        F.max("added").alias("last_seen"),
        F.min_by("title", "ordinal").alias("title"),
    )


def merge_leads(rows: DataFrame, key: str, page: str) -> DataFrame:
    """One product per key from leads of several sources.

    ``seen_count`` counts distinct pages, a lead without one by source and title. Title, image and identity are the first that
    are not empty, the summary the longest reason, score the highest base score, tags all distinct ones in order.
    """
    source = F.when(F.col(page) != "", F.col(page)).otherwise(F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("title", F.lit(""))))
    real = F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(0.0))
    first = lambda c: F.min_by(F.nullif(c, F.lit("")), F.when(F.col(c) != "", F.col("ordinal"))).alias(c)
    merged = rows.groupBy(key).agg(
        F.count_distinct(source).alias("seen_count"),
        F.min_by("title", "ordinal").alias("title"),
        first("image"),
        first("product_identity"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), F.struct(F.length("reason"), -F.col("ordinal")))).alias("summary"),
        F.sum(F.coalesce("likes", F.lit(0))).alias("likes"),
        F.min("added").alias("first_seen"),
        F.max("added").alias("last_seen"),
        F.max(F.greatest(F.lit(0), F.least(F.lit(100), (real * 5).cast("int") * 2))).alias("score"),
    )
    tags = rows.select(key, F.explode("tags").alias("tag")).groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return merged.join(tags, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def latest_decisions(rows: DataFrame, key: list[str], at: str, ordinal: str, action: str, clear: str) -> DataFrame:
    """The decision standing per key, without those whose last one is ``clear``; ``since`` orders them by the first decision since the last ``clear``.

    Aggregated map-side: the last decision, the last withdrawal, and the first decision after it. A null time is the earliest.
    """
    order = F.struct(F.col(at).alias("at"), F.col(ordinal).alias("ordinal"))
    rows = rows.withColumn("_o", order)
    gone = rows.where(F.col(action) == clear).groupBy(*key).agg(F.max("_o").alias("_gone"))
    kept = rows.where(F.col(action) != clear).join(gone, key, "left").where(F.col("_gone").isNull() | (F.col("_o") > F.col("_gone"))).drop("_gone")
    whole = F.struct(*[F.col(c) for c in kept.columns if c not in key])
    last = kept.groupBy(*key).agg(F.max_by(whole, F.col("_o")).alias("_row"), F.min("_o").alias("since"))
    return last.select(*key, "_row.*", "since").drop("_o")


def profile(rows: DataFrame, group: str, fields: dict[str, Column], k: int) -> DataFrame:
    """``(group, field, value, n)``: the ``k`` commonest values of every field in each group; fields are arrays, blank values count nothing."""
    none = F.array().cast("array<string>")
    each = lambda name, c: F.transform(F.coalesce(c, none), lambda v: F.struct(F.lit(name).alias("field"), F.trim(v).alias("value")))
    pairs = F.flatten(F.array(*[each(n, c) for n, c in fields.items()]))
    counts = rows.select(group, F.inline(pairs)).where("value <> ''").groupBy(group, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(group, "field").orderBy(F.desc("n"), F.asc("value")))
    return counts.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def stats(rows: DataFrame, group: str, fields: dict[str, Column], ordinal: str, limits: dict[str, int]) -> DataFrame:
    """``(group, field, value, n)``: counts of every field in each group, of the fields in ``limits`` only the commonest."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in fields.items()])
    counts = rows.select(group, ordinal, F.inline(pairs)).groupBy(group, "field", "value").agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("_first"))
    place = F.row_number().over(Window.partitionBy(group, "field").orderBy(F.desc("n"), F.asc("_first")))
    most = F.coalesce(*[F.when(F.col("field") == f, n) for f, n in limits.items()], F.lit(1 << 30))
    return counts.withColumn("_place", place).where(F.col("_place") <= most).drop("_place", "_first")
