"""Queries over constrained selections and composed duplicate tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.functions import text, times, values
from leadlens.operators import neardup, resolution, selection
from leadlens.plans import catalog
from leadlens.plans.registry import query
from leadlens.session import let_go, materialise, release, table

#: Example caps, minimums, quotas and lanes; all are parameters of the operators.
CAPS = {"category": ({"创意厨具": 7, "水杯": 6, "日历": 6}, 5), "source_name": ({}, 5)}
MINIMUMS = ("category", {"日历": 4, "水杯": 5, "创意厨具": 5})
QUOTAS = ("source_family", {"奖项": 8, "媒体案例": 6, "社区": 5, "市场信号": 3, "社媒": 3})
LANES = {"结构启发": 30, "功能启发": 45, "仅作灵感": 25}
LIMIT = 40


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Records of known days with the key that tells duplicates."""
    rows = table(spark, d, "records").where("first_seen <> 'unknown'").withColumn("day", F.col("first_seen"))
    key = values.first_nonempty(F.col("id"), text.compat_key(F.col("url")), text.compat_key(F.col("title")))
    rank = F.when(F.col("source_quality") == "premium", 0).when(F.col("source_quality") == "weak", 2).otherwise(1)
    return rows.withColumns({"key": F.coalesce(key, F.lit("")), "quality": rank})


_ORDER = [("score", True), ("seen_count", True), ("ordinal", False)]
_FILL = [("quality", False), ("score", True), ("seen_count", True), ("title", False), ("ordinal", False)]


def _order(parts: list[tuple[str, bool]]) -> list:
    return [(F.col(c), True) if down else F.col(c) for c, down in parts]


@query("daily_groups")
def daily_groups(spark: SparkSession, d: str) -> DataFrame:
    """The pick of every day: minimums of categories, quotas of families, balanced fill, under caps of category and source."""
    return selection.constrained_selection(pool(spark, d), "day", "key", "ordinal", _order(_ORDER), LIMIT, CAPS, MINIMUMS, QUOTAS, ("category", "source_family"), _order(_FILL))


@query("backlog_picks")
def backlog_picks(spark: SparkSession, d: str) -> DataFrame:
    """A greedy pick of the whole backlog: the rarest category and source first, then quality, innovation and title; one row a title."""
    rows = table(spark, d, "records").where("is_backfill").withColumns({"all": F.lit("backlog"), "core": text.core_title(F.col("title"))}).where("core <> ''")
    order = [(F.coalesce("quality_score", F.lit(0)), True), (F.coalesce("innovation", F.lit(0)), True), F.col("title"), F.col("ordinal")]
    caps = {"category": (CAPS["category"][0], 3), "source_name": ({}, 5)}
    return selection.constrained_selection(rows, "all", "core", "ordinal", order, LIMIT, caps, balance=("category", "source_name")).drop("all")


@query("weekly_picks")
def weekly_picks(spark: SparkSession, d: str) -> DataFrame:
    """A hundred records by lanes: quotas, twelve of a category until the pick is four fifths full, no two with a common key."""
    rows = table(spark, d, "records").where("coalesce(score, 0) >= 60 and url <> ''").withColumn("keys", text.row_keys(F.col("id"), F.col("url"), F.col("title")))
    return selection.lane_selection(rows, "action_lane", LANES, "keys", "category", "ordinal", _order([("score", True), ("seen_count", True), ("last_seen", True), ("ordinal", False)]), 100, 12, 0.8)


@query("back_filled")
def back_filled(spark: SparkSession, d: str) -> DataFrame:
    """Days that stayed short, but for the latest, filled with rows of their day or earlier that no day has picked."""
    rows = pool(spark, d)
    groups = materialise(daily_groups(spark, d), "groups")
    counts = groups.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    latest = counts.agg(F.max("day").alias("latest"))
    short = counts.join(latest, F.col("day") < F.col("latest")).select("day", (times.day_target(F.col("day"), "2026-07-20", LIMIT, 30) - F.col("n")).alias("missing")).where("missing > 0")
    picked = groups.join(rows.select("ordinal", "key", "category", "source_family"), "ordinal")
    reserve = rows.join(picked.select("key").distinct(), "key", "left_anti")
    order = _order([("quality", False), ("score", True), ("seen_count", True), ("title", False), ("ordinal", False)])
    return selection.back_fill(short, picked, reserve, "day", "key", "ordinal", "category", "source_family", CAPS["category"], order)


@query(
    "near_dup_core",
    """with c as (select core, list_sort(list_distinct(list_filter(string_split(core, ' '), lambda t: length(t) > 1))) as t, min(ordinal) as id from (select ordinal, {core} as core from records) where core <> '' group by core)
    select x.id as a, y.id as b from c x join c y on x.id < y.id where len(x.t) + len(y.t) > 0 and len(list_intersect(x.t, y.t)) >= 0.78 * len(list_distinct(list_concat(x.t, y.t))) - 1e-9""".replace(
        "{core}", rf"trim(regexp_replace(regexp_replace(lower({catalog.nfkc_sql('coalesce(title, chr(32))')}), '\b(?:{'|'.join(text.CORE_NOISE)})\b', ' ', 'g'), '[^a-z0-9一-鿿]+', ' ', 'g'))"
    ),
)
def near_dup_core(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records whose core titles share 0.78 of their words, between the smallest ordinals of each core title."""
    rows = table(spark, d, "records").withColumn("core", text.core_title(F.col("title"))).where("core <> ''")
    rows = rows.groupBy("core").agg(F.min("ordinal").alias("ordinal")).withColumn("block", F.lit(""))
    tokens = F.filter(F.split("core", " "), lambda t: F.length(t) > 1)
    return neardup.jaccard_texts(rows, "ordinal", "block", tokens, 0.78).select("a", "b")


def duplicate_links(spark: SparkSession, d: str) -> DataFrame:
    """``(a, b)``: leads of one or a blank category that are one product by title words, by title string or by a shared identity key.

    Copies are linked to the smallest ordinal of their kind.
    """
    leads = table(spark, d, "leads")
    block, tokens = F.coalesce("category", F.lit("")), text.title_tokens(F.col("title"))
    rows = materialise(catalog.with_entity_keys(leads).select("ordinal", block.alias("category"), tokens.alias("tokens"), "keys"), "titles")
    words = rows.withColumn("w", F.array_join("tokens", " "))
    sets = neardup.classes(rows, "ordinal", "category", F.col("tokens")).where("ordinal <> rep and size(tokens) >= 2").select(F.col("rep").alias("a"), F.col("ordinal").alias("b"))
    long = words.where("length(w) >= 8").select("ordinal", "category", "w")
    same = long.join(long.groupBy("category", "w").agg(F.min("ordinal").alias("a")), ["category", "w"]).where("ordinal <> a").select("a", F.col("ordinal").alias("b"))
    each = rows.select("ordinal", F.explode("keys").alias("key"))
    shared = each.join(each.groupBy("key").agg(F.min("ordinal").alias("a")), "key").where("a <> ordinal").select("a", F.col("ordinal").alias("b"))
    equal = _kept(sets.union(same).union(shared))
    near = _kept(neardup.jaccard_pairs(rows.where("category <> ''"), "ordinal", "category", F.col("tokens"), 0.6).select("a", "b"))
    blank = _kept(neardup.blank_pairs(rows, "ordinal", "category", F.col("tokens"), 0.6).select("a", "b"))
    strings = _kept(neardup.gestalt_matches(words, "ordinal", "category", "w").select("a", "b"))
    release(rows)
    return equal.union(near).union(blank).union(strings).distinct()


def _kept(links: DataFrame) -> DataFrame:
    """Links of one kind, written, so that the shuffle files they were made with go before the next kind is looked for."""
    kept = materialise(links, "links")
    let_go(links.sparkSession)
    return kept


@query("duplicate_products")
def duplicate_products(spark: SparkSession, d: str) -> DataFrame:
    """Every lead with the smallest ordinal of the products it is a duplicate of, over any number of links, and its number of links."""
    links = materialise(duplicate_links(spark, d), "links")
    found = resolution.from_edges(table(spark, d, "leads").select("ordinal"), "ordinal", links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = links.select(F.explode(F.array("a", "b")).alias("ordinal")).groupBy("ordinal").agg(F.count(F.lit(1)).alias("links"))
    return found.join(degree, "ordinal", "left").withColumn("links", F.coalesce("links", F.lit(0)))
