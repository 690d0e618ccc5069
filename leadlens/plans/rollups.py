"""Queries over joins, aggregates, windows, set operations, selection and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadlens.functions import text, url, values
from leadlens.operators import aggregates, joins, neardup, resolution, selection, windows
from leadlens.plans import catalog
from leadlens.plans.registry import query
from leadlens.session import table
from leadlens.streaming import changes, feedback


@query("anti_seen", "select ordinal from leads where id is not null and id not in (select id from records where id is not null)")
def anti_seen(spark: SparkSession, d: str) -> DataFrame:
    return joins.fresh(table(spark, d, "leads").where("id is not null").select("ordinal", "id"), table(spark, d, "records").where("id is not null"), "id").select("ordinal")


@query("semi_listed", "select ordinal from feedback_events where product_id in (select id from records)")
def semi_listed(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "feedback_events").select("ordinal", F.col("product_id").alias("id"))
    return joins.listed(events, table(spark, d, "records"), "id").select("ordinal")


@query(
    "left_default",
    "select e.ordinal, coalesce(r.quality, 'none') as quality from feedback_events e left join (select id, min(source_quality) as quality from records where id <> '' group by id) r on e.product_id = r.id",
)
def left_default(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "feedback_events").select("ordinal", F.col("product_id").alias("id"))
    known = table(spark, d, "records").where("id <> ''").groupBy("id").agg(F.min("source_quality").alias("quality"))
    return joins.with_default(events, known, "id", {"quality": F.lit("none")}).select("ordinal", "quality")


@query("count_by_category", "select category, count(*) as n, min(ordinal) as first from records group by category")
def count_by_category(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.count_by(table(spark, d, "records"), F.col("category"), "category", "ordinal")


@query("count_exploded", "select axis, count(*) as n, min(ordinal) as first from (select unnest(axes) as axis, ordinal from records) group by axis")
def count_exploded(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.count_exploded(table(spark, d, "records"), F.col("axes"), "axis", "ordinal")


@query(
    "count_default_tags",
    "select tag, count(*) as n, min(ordinal) as first from (select unnest(case when len(tags) > 0 then tags else [source_group] end) as tag, ordinal from leads) where tag is not null group by tag",
)
def count_default_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array("source_group"))
    return aggregates.count_exploded(table(spark, d, "leads"), tags, "tag", "ordinal").where("tag is not null")


@query("sum_array_sizes", "select source, cast(sum(coalesce(len(tags), 0)) as bigint) as tags, count(*) as n from leads group by source")
def sum_array_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").groupBy("source").agg(F.sum(F.coalesce(F.array_size("tags"), F.lit(0))).alias("tags"), F.count(F.lit(1)).alias("n"))


@query("top_counts", "select source_name, n, first from (select source_name, count(*) as n, min(ordinal) as first from records group by 1) order by n desc, first limit 8")
def top_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.most_common(aggregates.count_by(table(spark, d, "records"), F.col("source_name"), "source_name", "ordinal"), 8)


@query(
    "top_counts_by_lane",
    """select action_lane, category, n, first, place from (select action_lane, category, count(*) as n, min(ordinal) as first, row_number() over (partition by action_lane order by count(*) desc, min(ordinal)) as place
    from records group by 1, 2) where place <= 3""",
)
def top_counts_by_lane(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.top_counts_by(table(spark, d, "records"), "action_lane", "category", "ordinal", 3).withColumn("place", F.col("place").cast("long"))


@query(
    "quota_fill",
    "select f.source_family, f.quota, least(coalesce(n, 0), f.quota) as filled from (select distinct family as source_family, 40 as quota from source_dim) f left join (select source_family, count(*) as n from records group by 1) r using (source_family)",
)
def quota_fill(spark: SparkSession, d: str) -> DataFrame:
    quotas = table(spark, d, "source_dim").select(F.col("family").alias("source_family"), F.lit(40).alias("quota")).distinct()
    return aggregates.quota_fill(table(spark, d, "records"), "source_family", quotas)


@query("distinct_by_coalesced_key", "select count(distinct coalesce(nullif(id, ''), nullif(url, ''), nullif(title, ''))) as n from records")
def distinct_by_coalesced_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").agg(F.count_distinct(values.first_nonempty(F.col("id"), F.col("url"), F.col("title"))).alias("n"))


@query(
    "latest_decision",
    """select actor_id, product_id, action from (select coalesce(nullif(actor_id, ''), 'anonymous') as actor_id, product_id, lower(trim(action)) as action,
      row_number() over (partition by coalesce(nullif(actor_id, ''), 'anonymous'), product_id order by created_at desc nulls last, ordinal desc) as n
    from feedback_events where lower(trim(action)) in ('like', 'pass', 'clear') and product_id <> '') where n = 1 and action <> 'clear'""",
)
def latest_decision(spark: SparkSession, d: str) -> DataFrame:
    actor, action = values.nz(F.col("actor_id"), "anonymous"), F.lower(F.trim("action"))
    rows = table(spark, d, "feedback_events").select(actor.alias("actor_id"), "product_id", action.alias("action"), "created_at", "ordinal")
    rows = rows.where(F.col("action").isin(*feedback.ACTIONS) & (F.col("product_id") != ""))
    return windows.keep_last(rows, ["actor_id", "product_id"], [F.col("created_at"), F.col("ordinal")]).where("action <> 'clear'").select("actor_id", "product_id", "action")


@query(
    "merge_last_wins",
    "select event_id, ordinal, action from (select event_id, ordinal, action, row_number() over (partition by event_id order by ordinal desc) as n from feedback_events where event_id <> '') where n = 1",
)
def merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feedback_events").where("event_id <> ''").select("event_id", "ordinal", "action")
    return windows.keep_last(rows, ["event_id"], [F.col("ordinal")])


_STANDING = """
with c as (select event_id, actor_id, product_id, lower(trim(action)) as action, reason, created_at, received_at from feedback_events where event_id <> '' and actor_id <> '' and product_id <> ''),
l as (select *, row_number() over (partition by event_id order by received_at desc nulls last, created_at desc nulls last, actor_id desc, product_id desc, action desc, reason desc nulls last) as n from c where action in ('like', 'pass', 'clear')),
s as (select *, row_number() over (partition by actor_id, product_id order by coalesce(created_at, received_at) desc nulls last, received_at desc nulls last, event_id desc) as k from l where n = 1),
votes as (select actor_id, product_id, action from s where k = 1 and action <> 'clear')
"""


@query(
    "preference_counts",
    _STANDING
    + """, r as (select id, min(category) as category, min(source_family) as source_family, min(action_lane) as action_lane from records where id <> '' group by id)
    select action, field, value, count(*) as n from (select v.action, u.field, u.value from votes v join r on v.product_id = r.id,
      lateral (select unnest(['category', 'source_family', 'action_lane']) as field, unnest([r.category, r.source_family, r.action_lane]) as value) u) where value <> '' group by all""",
)
def preference_counts(spark: SparkSession, d: str) -> DataFrame:
    fields = ["category", "source_family", "action_lane"]
    votes = changes.standing_votes(table(spark, d, "feedback_events"), "reason")
    items = table(spark, d, "records").where("id <> ''").groupBy(F.col("id").alias("product_id")).agg(*[F.min(f).alias(f) for f in fields])
    long = votes.join(items, "product_id").unpivot(["action"], fields, "field", "value")
    return long.where("value <> ''").groupBy("action", "field", "value").agg(F.count(F.lit(1)).alias("n"))


@query("blocked_products", _STANDING + " select product_id, count(*) filter (action = 'pass') as passes, count(*) filter (action = 'like') as likes from votes group by product_id having passes > likes")
def blocked_products(spark: SparkSession, d: str) -> DataFrame:
    votes = changes.standing_votes(table(spark, d, "feedback_events"), "reason")
    sums = votes.groupBy("product_id").agg(F.count_if(F.col("action") == "pass").alias("passes"), F.count_if(F.col("action") == "like").alias("likes"))
    return sums.where("passes > likes")


@query(
    "rate_guard",
    """select ordinal from (select ordinal, row_number() over (partition by actor_id, floor(epoch(received_at) / 86400) order by received_at, ordinal) as n
    from feedback_events where actor_id <> '' and received_at is not null) where n <= 20""",
)
def rate_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feedback_events").where("actor_id <> '' and received_at is not null").select("ordinal", "actor_id", "received_at")
    return windows.rate_limited(rows, "actor_id", "received_at", [F.col("received_at"), F.col("ordinal")], 20).select("ordinal")


@query("accept_window", "select ordinal from feedback_events where created_at >= received_at - interval 30 day and created_at <= received_at + interval 10 minute")
def accept_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feedback_events").where(feedback.in_window(F.col("created_at"), F.col("received_at"))).select("ordinal")


@query(
    "event_validity",
    """select ordinal, coalesce(a in ('like', 'pass', 'clear') and case when a = 'pass' then r in ('bad_evidence', 'hard_to_execute', 'low_margin', 'too_ordinary', 'weak_function', 'wrong_category') else r = '' end
      and coalesce(length(actor_id) between 1 and 128 and length(product_id) between 1 and 128, false), false) as valid
    from (select *, lower(trim(action)) as a, replace(replace(lower(trim(coalesce(reason, ''))), '-', '_'), ' ', '_') as r from feedback_events)""",
)
def event_validity(spark: SparkSession, d: str) -> DataFrame:
    ok = feedback.valid(F.col("action"), F.col("reason"), F.col("actor_id"), F.col("product_id"))
    return table(spark, d, "feedback_events").select("ordinal", ok.alias("valid"))


@query(
    "health_counts",
    "select lower(trim(action)) as action, count(*) as n, epoch_us(max(received_at)) as latest_us from feedback_events where lower(trim(action)) in ('like', 'pass', 'clear') group by 1",
)
def health_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feedback_events").withColumn("action", F.lower(F.trim("action"))).where(F.col("action").isin(*feedback.ACTIONS))
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("received_at")).alias("latest_us"))


@query("daily_action_counts", "select cast(created_at as date) as day, lower(trim(action)) as action, count(*) as n from feedback_events where created_at is not null group by 1, 2")
def daily_action_counts(spark: SparkSession, d: str) -> DataFrame:
    return feedback.daily_counts(table(spark, d, "feedback_events"))


@query(
    "top_per_family",
    "select ordinal, source_family, rank from (select ordinal, source_family, row_number() over (partition by source_family order by score desc nulls last, ordinal) as rank from records) where rank <= 8",
)
def top_per_family(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "records").select("ordinal", "source_family", "score")
    return windows.top_k(rows, ["source_family"], [F.desc_nulls_last("score"), F.asc("ordinal")], 8).select("ordinal", "source_family", F.col("rank").cast("long").alias("rank"))


@query(
    "round_robin",
    "select ordinal, category, turn from (select ordinal, category, row_number() over (partition by category order by score desc nulls last, ordinal) as turn from records where category <> '')",
)
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "records").where("category <> ''").select("ordinal", "category", "score")
    placed = windows.round_robin(rows, "category", [F.desc_nulls_last("score"), F.asc("ordinal")], F.col("category"))
    return placed.select("ordinal", "category", F.col("position._turn").cast("long").alias("turn"))


@query("rotation", "select source, place from (select source, ((row_number() over (order by source) - 1 - 5) % 28 + 28) % 28 as place from source_dim)")
def rotation(spark: SparkSession, d: str) -> DataFrame:
    numbered = table(spark, d, "source_dim").select("source", (F.row_number().over(Window.orderBy("source")) - 1).cast("long").alias("n"))
    return numbered.select("source", windows.rotated(F.col("n"), 5, 28).cast("long").alias("place"))


@query(
    "week_rollup",
    "select strftime(added, '%G-W%V') as week, count(*) as leads, count(distinct source) as sources, cast(sum(coalesce(likes, 0)) as bigint) as likes from leads where added is not null group by 1",
)
def week_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "leads").where("added is not null").withColumn("week", values.iso_week(F.col("added")))
    return rows.groupBy("week").agg(F.count(F.lit(1)).alias("leads"), F.count_distinct("source").alias("sources"), F.sum(F.coalesce("likes", F.lit(0))).alias("likes"))


@query(
    "day_group_stats",
    "select first_seen as day, action_lane, count(*) as n, count(*) filter (is_backfill) as backfilled from records where first_seen <> 'unknown' group by 1, 2",
)
def day_group_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "records").where("first_seen <> 'unknown'")
    return rows.groupBy(F.col("first_seen").alias("day"), "action_lane").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_backfill").alias("backfilled"))


@query(
    "union_keep_first",
    """select key, part, ordinal from (select *, row_number() over (partition by key order by part, ordinal) as n from (
      select id as key, 0 as part, ordinal from records where id <> '' union all select id, 1, ordinal from leads where id <> '')) where n = 1""",
)
def union_keep_first(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).where("id <> ''").select(F.col("id").alias("key"), F.lit(i).alias("part"), "ordinal") for i, t in enumerate(("records", "leads"))]
    return joins.union_keep_first(parts, ["key"], [F.col("ordinal")])


@query("except_by_id", "select ordinal from records where coalesce(id, '') not in (select product_id from feedback_events where product_id is not null and action = 'clear')")
def except_by_id(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "feedback_events").select(F.col("product_id").alias("id"), "action").where("id is not null and action = 'clear'")
    return table(spark, d, "records").select("ordinal", values.nz(F.col("id")).alias("id")).join(gone.select("id").distinct(), "id", "left_anti").select("ordinal")


@query(
    "upsert_by_id",
    """with o as (select id, min(score) as score from records where id <> '' group by id), n as (select id, cast(round_even(max(case when isnan(score) then null else score end) * 10, 0) as int) as score from leads where id <> '' group by id)
    select coalesce(n.id, o.id) as id, case when n.id is not null then n.score else o.score end as score from o full join n on o.id = n.id""",
)
def upsert_by_id(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "records").where("id <> ''").groupBy("id").agg(F.min("score").alias("score"))
    real = F.when(~F.isnan("score"), F.col("score"))
    new = table(spark, d, "leads").where("id <> ''").groupBy("id").agg(F.bround(F.max(real) * 10).cast("int").alias("score"))
    return joins.upsert(old, new, "id")


SNAPSHOT_SQL = """with p as (select first_seen as day, ordinal, title, 0 as age from records where is_backfill and title <> ''), c as (select first_seen as day, ordinal, title, 1 as age from records where not is_backfill and title <> ''),
    k as (select *, row_number() over (partition by day, title order by age, ordinal) as n from (from p union all from c))
    select day, title, ordinal from (select *, row_number() over (partition by day order by age, ordinal) as m from k where n = 1) where m <= 10"""


@query("snapshot_merge", SNAPSHOT_SQL)
def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "records").where("title <> ''").select(F.col("first_seen").alias("day"), "ordinal", "title", "is_backfill")
    before, now = rows.where("is_backfill").drop("is_backfill"), rows.where("not is_backfill").drop("is_backfill")
    return joins.snapshot_merge(before, now, "day", "title", F.col("ordinal"), 10).select("day", "title", "ordinal")


@query(
    "accumulate_new",
    """with u as (select ordinal, id, lower(title) as t, row_number() over (partition by id order by ordinal) as n from leads where id <> '' and title <> '')
    select ordinal from u where n = 1 and id not in (select id from records where id is not null) and t not in (select lower(title) from records where title is not null)""",
)
def accumulate_new(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "leads").where("id <> '' and title <> ''").select("ordinal", "id", F.lower("title").alias("t"))
    first = windows.keep_first(rows, ["id"], [F.col("ordinal")])
    known = table(spark, d, "records").select("id", F.lower("title").alias("t"))
    return joins.fresh(joins.fresh(first, known.where("id is not null"), "id"), known.where("t is not null"), "t").select("ordinal")


@query(
    "first_seen_state",
    "select key, min(day) as day from (select id as key, first_seen as day from records where id <> '' and first_seen <> 'unknown' union all select id, cast(added as varchar) from leads where id <> '' and added is not null) group by key",
)
def first_seen_state(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "records").where("id <> '' and first_seen <> 'unknown'").select(F.col("id").alias("key"), F.col("first_seen").alias("day"))
    new = table(spark, d, "leads").where("id <> '' and added is not null").select(F.col("id").alias("key"), F.col("added").cast("string").alias("day"))
    return aggregates.first_seen(old, new, "key", "day")


@query(
    "pool_order",
    "select ordinal, score, seen_count from (select ordinal, score, seen_count, last_seen from records) order by score desc nulls last, seen_count desc nulls last, last_seen desc nulls last, ordinal limit 100",
)
def pool_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "records").select("ordinal", "score", "seen_count", "last_seen")
    order = [F.desc_nulls_last("score"), F.desc_nulls_last("seen_count"), F.desc_nulls_last("last_seen"), F.asc("ordinal")]
    return rows.orderBy(*order).limit(100).drop("last_seen")


@query(
    "merged_products",
    f"""with {catalog._PARTS}, x as (select c.url as key, l.* from canon c join leads l using (ordinal) where c.url <> '')
    select key, count(distinct url) as sources, max(case when isnan(score) then null else score end) as score, cast(sum(coalesce(likes, 0)) as bigint) as likes, min(added) as first_seen, max(added) as last_seen from x group by key""",
)
def merged_products(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "leads").withColumn("key", url.canonical(F.col("url"))).where("key <> ''")
    rows = rows.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    return aggregates.merged_products(rows, "key").select("key", "sources", "score", "likes", "first_seen", "last_seen")


_KEYS = f"""{catalog._PARTS}, {catalog._FINGERPRINT}, {catalog._IDENTITY},
    keys as (select ordinal as id, 'u' || url as key from canon where url <> '' union all select ordinal, 'p' || product_key from prints union all select ordinal, 'f' || fingerprint from prints
      union all select ordinal, 'k' || unnest(keys) from identities),
    e as (select distinct k.id as a, m.id as b from keys k join (select key, min(id) as id from keys group by key) m using (key) where k.id <> m.id),
    both_ways as (select a, b from e union select b, a from e),
    reach(id, c) as (select ordinal, ordinal from leads union select w.a, r.c from reach r join both_ways w on w.b = r.id where r.c < w.a),
    labels as (select id as ordinal, min(c) as component from reach group by id)"""


def with_resolved_keys(leads: DataFrame) -> DataFrame:
    """Leads with all keys by which they are one product: page, product key, content fingerprint and identity keys."""
    keyed = catalog.with_fingerprints(catalog.with_entity_keys(leads, "_ik"))
    page = url.canonical(F.col("url"))
    own = F.array(F.when(page != "", F.concat(F.lit("u"), page)), F.concat(F.lit("p"), "product_key"), F.concat(F.lit("f"), "fingerprint"))
    return keyed.withColumn("keys", F.array_compact(F.concat(own, F.transform("_ik", lambda k: F.concat(F.lit("k"), k))))).drop("_ik", "product_key", "fingerprint")


@query("er_components", f"with recursive {_KEYS} select * from labels")
def er_components(spark: SparkSession, d: str) -> DataFrame:
    """Leads that share any key, over any number of steps, with the smallest ordinal of their component."""
    return resolution.components(with_resolved_keys(table(spark, d, "leads")).select("ordinal", "keys"), "ordinal", "keys")


_SETS = f"(select ordinal, category, list_sort(list_distinct({catalog._TITLE_TOKENS})) as t from leads where category <> '')"


@query(
    "near_dup_jaccard",
    f"""with c as (select category, t, min(ordinal) as id from {_SETS} where len(t) >= 2 group by all)
    select x.id as a, y.id as b from c x join c y on x.category = y.category and x.id < y.id where len(list_intersect(x.t, y.t)) >= 0.6 * len(list_distinct(list_concat(x.t, y.t))) - 1e-9""",
)
def near_dup_jaccard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "leads").where("category <> ''")
    return neardup.jaccard_pairs(rows, "ordinal", "category", text.title_tokens(F.col("title")), 0.6).select("a", "b")


_ALL_SETS = f"(select ordinal, coalesce(category, '') as category, list_sort(list_distinct({catalog._TITLE_TOKENS})) as t from leads)"


@query("near_dup_classes", f"select ordinal, case when len(t) >= 2 then min(ordinal) over (partition by category, t) else ordinal end as class from {_ALL_SETS}")
def near_dup_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every lead with the smallest ordinal of its category and token set, which stands for it in near_dup_jaccard and near_dup_blank.

    A blank category is one of its own here. Titles under two tokens stand for themselves.
    """
    rows = table(spark, d, "leads").withColumn("category", F.coalesce("category", F.lit("")))
    found = neardup.classes(rows, "ordinal", "category", text.title_tokens(F.col("title")))
    return found.select("ordinal", F.when(F.size("tokens") >= 2, F.col("rep")).otherwise(F.col("ordinal")).alias("class"))


@query(
    "near_dup_blank",
    f"""with c as (select category, t, min(ordinal) as id from {_ALL_SETS} where len(t) >= 2 group by all)
    select x.id as a, y.id as b from c x join c y on x.id < y.id and (x.category = '' or y.category = '') where len(list_intersect(x.t, y.t)) >= 0.6 * len(list_distinct(list_concat(x.t, y.t))) - 1e-9""",
)
def near_dup_blank(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that near_dup_jaccard leaves out: a blank category goes with any."""
    return neardup.blank_pairs(table(spark, d, "leads"), "ordinal", "category", text.title_tokens(F.col("title")), 0.6).select("a", "b")


@query("near_dup_gestalt")
def near_dup_gestalt(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose word strings match by gestalt ratio 0.9, between the smallest ordinals of each category and word string; a blank category goes with any."""
    rows = table(spark, d, "leads").select("ordinal", "category", F.array_join(text.title_tokens(F.col("title")), " ").alias("w"))
    return neardup.gestalt_matches(rows, "ordinal", "category", "w").select("a", "b", F.round("ratio", 6).alias("ratio"))


@query("capped_selection")
def capped_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "records").where("first_seen <> 'unknown' and category <> '' and source_name <> ''").select(F.col("first_seen").alias("day"), "category", "source_name", "score", "ordinal")
    return selection.capped_selection(rows, "day", {"category": 5, "source_name": 5}, 40, [F.desc_nulls_last("score"), F.asc("ordinal")], "ordinal")


@query("seeded_sample", "select ordinal from records order by sha1('s1' || cast(ordinal as varchar)), ordinal limit 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return selection.seeded_sample(table(spark, d, "records").select("ordinal"), "ordinal", 50, "s1")


@query(
    "balanced_sample",
    "select category, ordinal, place from (select category, ordinal, row_number() over (partition by category order by sha1('s1' || cast(ordinal as varchar)), ordinal) as place from records) where place <= 3",
)
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    return selection.balanced_sample(table(spark, d, "records").select("category", "ordinal"), "category", "ordinal", 3, "s1").select("category", "ordinal", F.col("place").cast("long").alias("place"))


@query(
    "usage_ledger",
    """select day, kind, n, total, cast(sum(n) over (partition by kind order by day) as bigint) as running from (select cast(ts as date) as day, event_type as kind, count(*) as n, cast(round(sum(value), 2) as double) as total from events group by 1, 2)""",
)
def usage_ledger(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )
    return daily.withColumn("running", F.sum("n").over(Window.partitionBy("kind").orderBy("day")))


@query(
    "funnel",
    "select batch_no, count(*) as arrived, count(*) filter (url <> '') as with_url, count(*) filter (agent_pre_review.keep) as kept, count(distinct category) as categories from leads group by batch_no",
)
def funnel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("arrived"), F.count_if(F.col("url") != "").alias("with_url"), F.count_if("agent_pre_review.keep").alias("kept"), F.count_distinct("category").alias("categories")
    )


@query(
    "order_rollup",
    "select n_name, cast(date_trunc('month', o_orderdate) as date) as month, count(*) as orders, count(distinct c_custkey) as customers from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2",
)
def order_rollup(spark: SparkSession, d: str) -> DataFrame:
    orders, customers, nations = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, customers.c_nationkey == nations.n_nationkey)
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    return joined.groupBy("n_name", month.alias("month")).agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("c_custkey").alias("customers"))


@query(
    "cap_violations",
    "select first_seen as day, category, count(*) as n from records where first_seen <> 'unknown' and category <> '' group by 1, 2 having count(*) > 5",
)
def cap_violations(spark: SparkSession, d: str) -> DataFrame:
    """Groups that break a cap: the check of a selection, as rows."""
    rows = table(spark, d, "records").where("first_seen <> 'unknown' and category <> ''")
    return rows.groupBy(F.col("first_seen").alias("day"), "category").agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@query(
    "merged_tags",
    "select ordinal, array_to_string(list_concat(a, list_filter(b, lambda x: not list_contains(a, x))[1:2]), ',') as tags from (select ordinal, coalesce(axes, [])[1:4] as a, [category, source_family, action_lane] as b from records)",
)
def merged_tags(spark: SparkSession, d: str) -> DataFrame:
    """Up to four labels and two more that are not among them; order and repeats stay."""
    first = F.slice(F.coalesce("axes", F.array().cast("array<string>")), 1, 4)
    rows = table(spark, d, "records").select("ordinal", first.alias("a"), F.array("category", "source_family", "action_lane").alias("b"))
    more = F.expr("slice(filter(b, x -> not array_contains(a, x)), 1, 2)")
    return rows.select("ordinal", F.array_join(F.concat("a", more), ",").alias("tags"))


@query(
    "row_key",
    r"""select ordinal, coalesce(nullif(id, ''), nullif(substr(regexp_replace(lower(coalesce(url, '')), '[^a-z0-\x5c]+', '', 'g'), 1, 120), ''), nullif(substr(regexp_replace(lower(coalesce(title, '')), '[^a-z0-\x5c]+', '', 'g'), 1, 120), '')) as key from records""",
)
def row_key(spark: SparkSession, d: str) -> DataFrame:
    """Identity of a row: id, else the key of its url, else that of its title."""
    key = values.first_nonempty(F.col("id"), text.compat_key(F.col("url")), text.compat_key(F.col("title")))
    return table(spark, d, "records").select("ordinal", key.alias("key"))


@query(
    "rotated_by_day",
    "select source, ((n - dayofyear(date '2026-08-21')) % 28 + 28) % 28 as place from (select source, row_number() over (order by source) - 1 as n from source_dim)",
)
def rotated_by_day(spark: SparkSession, d: str) -> DataFrame:
    """A ring of sources that begins anew each day of the year."""
    numbered = table(spark, d, "source_dim").select("source", (F.row_number().over(Window.orderBy("source")) - 1).cast("long").alias("n"))
    offset = F.dayofyear(F.to_date(F.lit("2026-08-21")))
    return numbered.select("source", F.pmod(F.col("n") - offset, F.lit(28)).cast("long").alias("place"))


@query(
    "interleaved",
    """select ordinal, category, row_number() over (order by turn, category) as place from (select ordinal, category, row_number() over (partition by category order by score desc nulls last, ordinal) as turn
    from records where category <> '') where turn <= 5""",
)
def interleaved(spark: SparkSession, d: str) -> DataFrame:
    """The first five of every category in turns: a report of bounded size, numbered."""
    rows = table(spark, d, "records").where("category <> ''").select("ordinal", "category", "score")
    turns = windows.top_k(rows, ["category"], [F.desc_nulls_last("score"), F.asc("ordinal")], 5, "turn")
    return turns.select("ordinal", "category", F.row_number().over(Window.orderBy("turn", "category")).cast("long").alias("place"))
