"""Queries over votes, reviews, merged products, orders and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadlens.functions import url, values
from leadlens.operators import aggregates, joins, orders, windows
from leadlens.plans import catalog, rollups
from leadlens.plans.registry import query
from leadlens.session import materialise, table
from leadlens.streaming import feedback

_EVENTS = """decided as (select coalesce(nullif(actor_id, ''), 'anonymous') as actor_id, product_id, lower(trim(action)) as action, reason, item_snapshot as s, created_at, ordinal from feedback_events
    where lower(trim(action)) in ('like', 'pass', 'clear') and product_id <> ''),
  runs as (select *, max(case when action = 'clear' then ordinal end) over w as cleared, row_number() over (partition by actor_id, product_id order by created_at desc nulls last, ordinal desc) as back
    from (select *, row_number() over (partition by actor_id, product_id order by created_at nulls first, ordinal) as nth from decided) window w as (partition by actor_id, product_id order by nth)),
  firsts as (select *, min_by({'at': coalesce(created_at, timestamp '0001-01-01'), 'ordinal': ordinal}, nth) over (partition by actor_id, product_id, cleared) as since from runs),
  votes as (select * from firsts where back = 1 and action <> 'clear')"""


def latest_votes(spark: SparkSession, d: str) -> DataFrame:
    """The decision standing per actor and product, with its snapshot and the place of the first decision since the last withdrawal."""
    actor, action = values.nz(F.col("actor_id"), "anonymous"), F.lower(F.trim("action"))
    rows = table(spark, d, "feedback_events").select(actor.alias("actor_id"), "product_id", action.alias("action"), "reason", "item_snapshot", "created_at", "ordinal")
    rows = rows.where(F.col("action").isin(*feedback.ACTIONS) & (F.col("product_id") != ""))
    return aggregates.latest_decisions(rows, ["actor_id", "product_id"], "created_at", "ordinal", "action", "clear")


@query(
    "preference_profile",
    f"""with {_EVENTS}, named as (select id, any_value(axes order by ordinal) as axes from records where id <> '' group by id),
    fields as (select v.action, u.field, u.value, v.since from votes v left join named n on v.product_id = n.id, lateral (
      select 'category' as field, trim(coalesce(v.s.category, '')) as value union all select 'source_family', trim(coalesce(v.s.source_family, '')) union all select 'action_lane', trim(coalesce(v.s.action_lane, ''))
      union all select 'axes', trim(x) from (select unnest(coalesce(n.axes, [])) as x)
      union all select 'reason', case when v.action = 'pass' then coalesce(v.reason, '') else '' end) u where u.value <> ''),
    counts as (select action, field, value, count(*) as n from fields group by all)
    select action, field, value, n from (select *, row_number() over (partition by action, field order by n desc, value) as place from counts) where place <= 8""",
)
def preference_profile(spark: SparkSession, d: str) -> DataFrame:
    """The eight commonest values of every field among likes and among passes, arrays by their members, with the reasons of passes."""
    axes = table(spark, d, "records").where("id <> ''").groupBy(F.col("id").alias("product_id")).agg(F.min_by("axes", "ordinal").alias("axes"))
    votes = latest_votes(spark, d).join(axes, "product_id", "left")
    single = {f: F.array(F.col(f"item_snapshot.{f}")) for f in ("category", "source_family", "action_lane")}
    single["reason"] = F.array(F.when(F.col("action") == "pass", F.col("reason")))
    return aggregates.profile(votes, "action", {**single, "axes": F.col("axes")}, 8)


@query(
    "preference_examples",
    f"""with {_EVENTS} select action, product_id, title, category, place from (select action, product_id, coalesce(s.title, '') as title, coalesce(s.category, '') as category,
      row_number() over (partition by action order by since) as place from votes) where place <= 12""",
)
def preference_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve products liked and passed, in the order in which their standing decisions began."""
    votes = latest_votes(spark, d).select("action", "product_id", values.nz(F.col("item_snapshot.title")).alias("title"), values.nz(F.col("item_snapshot.category")).alias("category"), "since")
    return windows.top_k(votes, ["action"], [F.col("since")], 12, "place").select("action", "product_id", "title", "category", F.col("place").cast("long").alias("place"))


@query("preference_stats", f"with {_EVENTS} select (select count(*) from feedback_events) as events, count(*) as active, count(*) filter (action = 'like') as likes, count(*) filter (action = 'pass') as passes from votes")
def preference_stats(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "feedback_events").agg(F.count(F.lit(1)).alias("events"))
    votes = latest_votes(spark, d).agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("action") == "like").alias("likes"), F.count_if(F.col("action") == "pass").alias("passes"))
    return events.crossJoin(votes)  # one row each


_MERGED = f"""x as (select l.component, r.*, c.url as page from labels l join leads r using (ordinal) join canon c using (ordinal)),
  tagged as (select component, list_sort(list_distinct(flatten(list(coalesce(tags, []))))) as tags from x group by component),
  merged as (select component, count(distinct case when page <> '' then page else coalesce(source, '') || '|' || coalesce(title, '') end) as seen_count,
    min_by(title, ordinal) as title, min_by(nullif(image, ''), ordinal) filter (image <> '') as image, min_by(product_identity, ordinal) filter (product_identity <> '') as product_identity,
    max_by(reason, (length(reason), -ordinal)) as summary, cast(sum(coalesce(likes, 0)) as bigint) as likes, min(added) as first_seen, max(added) as last_seen,
    max(cast(greatest(0, least(100, 2 * trunc(coalesce(case when isnan(score) then null else score end, 0) * 5))) as int)) as score from x group by component)"""


@query("er_merge", f"with recursive {rollups._KEYS}, {_MERGED} select m.* exclude (first_seen, last_seen), strftime(first_seen, '%Y-%m-%d') as first_seen, strftime(last_seen, '%Y-%m-%d') as last_seen, array_to_string(tags, ',') as tags from merged m join tagged using (component)")
def er_merge(spark: SparkSession, d: str) -> DataFrame:
    """One product per component of leads, with all that is merged: distinct sources, first image and identity, longest summary, sum of likes, sorted tags."""
    found = materialise(rollups.er_components(spark, d), "components")
    rows = table(spark, d, "leads").withColumn("page", url.canonical(F.col("url"))).join(found, "ordinal")
    merged = aggregates.merge_leads(rows, "component", "page")
    days = {c: F.date_format(c, "yyyy-MM-dd") for c in ("first_seen", "last_seen")}
    return merged.withColumns({**days, "tags": F.array_join("tags", ",")})


@query(
    "decision_merge",
    f"""with {_EVENTS}, tallies as (select product_id as id, case when count(*) filter (action = 'like') >= count(*) filter (action = 'pass') then true else false end as keep from votes group by product_id),
    p as (select ordinal, id, 'product' as pool from records where not is_backfill and id <> ''), r as (select ordinal, id, 'rejected' as pool from records where is_backfill and id <> '' and id not in (select id from p)),
    u as (from p union all from r)
    select u.ordinal, u.id, case when t.keep is null and pool = 'product' then 'kept' when t.keep is null then 'rejected' when t.keep and pool = 'rejected' then 'rescued' when t.keep then 'kept' else 'rejected' end as state from u left join tallies t on u.id = t.id""",
)
def decision_merge(spark: SparkSession, d: str) -> DataFrame:
    """Products and rejected ones after a set of decisions: kept, rejected, or rescued from the rejected."""
    tallies = latest_votes(spark, d).groupBy(F.col("product_id").alias("id")).agg((F.count_if(F.col("action") == "like") >= F.count_if(F.col("action") == "pass")).alias("keep"))
    rows = table(spark, d, "records").where("id <> ''").select("ordinal", "id", "is_backfill")
    return joins.apply_decisions(rows.where("not is_backfill").drop("is_backfill"), rows.where("is_backfill").drop("is_backfill"), tallies, "id").select("ordinal", "id", "state")


@query(
    "batch_guard",
    """with d as (select batch_no, id, min_by(agent_pre_review.keep, ordinal) as keep from leads where id <> '' and agent_pre_review.keep is not null group by all)
    select l.ordinal, d.keep from leads l join d on l.id = d.id and l.batch_no = d.batch_no""",
)
def batch_guard(spark: SparkSession, d: str) -> DataFrame:
    """Decisions count only for rows of the batch they were made for."""
    rows = table(spark, d, "leads").where("id <> ''").select("ordinal", "batch_no", "id", F.col("agent_pre_review.keep").alias("keep"))
    made = rows.where("keep is not null").groupBy("batch_no", "id").agg(F.min_by("keep", "ordinal").alias("keep"))
    return rows.drop("keep").join(made, ["batch_no", "id"]).select("ordinal", "keep")


_ACTOR = "(select min(actor_id) from feedback_events where actor_id <> '')"


@query("client_join", f"with {_EVENTS} select r.ordinal, coalesce(v.action, 'open') as action from records r left join (select product_id, action from votes where actor_id = {_ACTOR}) v on r.id = v.product_id")
def client_join(spark: SparkSession, d: str) -> DataFrame:
    """All items with the decisions of one actor, 'open' where there is none."""
    first = table(spark, d, "feedback_events").where("actor_id <> ''").agg(F.min("actor_id").alias("actor_id"))
    mine = latest_votes(spark, d).join(F.broadcast(first), "actor_id", "left_semi").select(F.col("product_id").alias("id"), "action")  # one row is broadcast
    return joins.with_default(table(spark, d, "records").select("ordinal", "id"), mine, "id", {"action": F.lit("open")}).select("ordinal", "action")


@query("client_summary", f"with {_EVENTS} select count(*) filter (v.action = 'like') as likes, count(*) filter (v.action = 'pass') as passes, count(*) filter (v.action is null) as open from records r left join (select product_id, action from votes where actor_id = {_ACTOR}) v on r.id = v.product_id")
def client_summary(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda a: F.count_if(F.col("action") == a)
    return client_join(spark, d).agg(is_("like").alias("likes"), is_("pass").alias("passes"), is_("open").alias("open"))


@query(
    "facets_with_feedback",
    f"with {_EVENTS}, t as (select product_id, count(*) filter (action = 'pass') > count(*) filter (action = 'like') as blocked from votes group by 1) select r.ordinal from records r left join t on r.id = t.product_id where r.category is not null and not coalesce(t.blocked, false) and contains(lower(concat_ws(' ', title, summary, source_name)), 'mug')",
)
def facets_with_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Items of a category with a word in their texts that the votes do not block."""
    blocked = latest_votes(spark, d).groupBy(F.col("product_id").alias("id")).agg((F.count_if(F.col("action") == "pass") > F.count_if(F.col("action") == "like")).alias("blocked")).where("blocked")
    whole = F.lower(F.concat_ws(" ", "title", "summary", "source_name"))
    rows = table(spark, d, "records").where(F.col("category").isNotNull() & F.contains(whole, F.lit("mug")))
    return joins.fresh(rows.select("ordinal", "id"), blocked, "id").select("ordinal")


@query(
    "review_summary",
    "select collected_at as day, count(*) as reviewed, count(*) filter (agent_pre_review.keep) as kept, count(*) filter (not agent_pre_review.keep) as rejected, count(distinct agent_pre_review.category) filter (agent_pre_review.keep) as categories from leads where agent_pre_review.keep is not null group by 1",
)
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of a day: how many, kept, rejected, and categories of the kept."""
    rows = table(spark, d, "leads").select("collected_at", "agent_pre_review.*").where("keep is not null")
    return rows.groupBy(F.col("collected_at").alias("day")).agg(
        F.count(F.lit(1)).alias("reviewed"), F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("rejected"), F.count_distinct(F.when(F.col("keep"), F.col("category"))).alias("categories")
    )


@query("review_tiers", "select collected_at as day, agent_pre_review.category as category, count(*) as n from leads where agent_pre_review.keep group by all")
def review_tiers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "leads").where("agent_pre_review.keep")
    return rows.groupBy(F.col("collected_at").alias("day"), F.col("agent_pre_review.category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "review_candidates",
    """with c as (select ordinal, id from leads where collected_at = date '2026-08-01' and list_contains(tags, source)),
    m as (select ordinal, id from leads where added = date '2026-08-01' and list_contains(tags, source) and id is not null and id not in (select id from c where id is not null)) from c union all from m""".replace("list_contains(tags, source)", "len(tags) > 0"),
)
def review_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a day and lane, and those of the rejected whose id is not among them."""
    rows = table(spark, d, "leads").where(F.size("tags") > 0).select("ordinal", "id", "collected_at", "added")
    own = rows.where("collected_at = date '2026-08-01'").select("ordinal", "id")
    more = rows.where("added = date '2026-08-01' and id is not null").select("ordinal", "id")
    return own.unionByName(joins.fresh(more, own.where("id is not null"), "id").select("ordinal", "id"))


@query(
    "displayed_counts",
    f"with m as ({rollups.SNAPSHOT_SQL}), c as (select distinct category from sample_targets) select c.category, count(r.ordinal) as n from c left join (select r.category, m.ordinal from m join records r using (ordinal)) r using (category) group by 1",
)
def displayed_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of every listed category the daily snapshots show; none counts as 0."""
    shown = rollups.snapshot_merge(spark, d).join(table(spark, d, "records").select("ordinal", "category"), "ordinal")
    listed = table(spark, d, "sample_targets").select("category").distinct()
    counts = shown.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return joins.with_default(listed, counts, "category", {"n": F.lit(0).cast("long")})


@query("open_slots", f"with m as ({rollups.SNAPSHOT_SQL}), c as (select distinct category from sample_targets) select category from (select c.category, count(r.ordinal) as n from c left join (select r.category, m.ordinal from m join records r using (ordinal)) r using (category) group by 1) where n < 5")
def open_slots(spark: SparkSession, d: str) -> DataFrame:
    """Categories whose shown rows are below the cap."""
    return displayed_counts(spark, d).where("n < 5").select("category")


@query(
    "group_stats",
    """with r as (select first_seen as day, category, action_lane, source_family, is_backfill, ordinal from records where first_seen <> 'unknown'),
    c as (select day, 'lane' as field, action_lane as value, count(*) as n, min(ordinal) as first from r group by all union all select day, 'category', category, count(*), min(ordinal) from r group by all union all select day, 'family', source_family, count(*), min(ordinal) from r group by all
      union all select day, 'backfill', cast(is_backfill as varchar), count(*), min(ordinal) from r group by all)
    select day, field, value, n from (select *, row_number() over (partition by day, field order by n desc, first) as place from c) where field <> 'category' or place <= 12""",
)
def group_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each day by lane, family, back-fill and the twelve commonest categories."""
    rows = table(spark, d, "records").where("first_seen <> 'unknown'").withColumn("day", F.col("first_seen"))
    fields = {"lane": F.col("action_lane"), "category": F.col("category"), "family": F.col("source_family"), "backfill": F.col("is_backfill").cast("string")}
    return aggregates.stats(rows, "day", fields, "ordinal", {"category": 12})


@query(
    "dashboard_metrics",
    "select count(*) as items, count(distinct category) as categories, count(distinct source_family) as families, count(*) filter (image <> '') as with_image, count(*) filter (is_backfill) as backfilled, count(distinct first_seen) as days, max(score) as best from records",
)
def dashboard_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("category").alias("categories"), F.count_distinct("source_family").alias("families"), F.count_if(F.col("image") != "").alias("with_image"),
        F.count_if("is_backfill").alias("backfilled"), F.count_distinct("first_seen").alias("days"), F.max("score").alias("best"),
    )


@query(
    "source_totals",
    "with s as (select s.source, count(l.ordinal) as n from source_dim s left join leads l on s.source = l.source and l.url <> '' group by 1) select cast(sum(n) as bigint) as total, coalesce(string_agg(case when n = 0 then source end, ',' order by source), '') as failed from s",
)
def source_totals(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the listed sources and the sources without any; their number is that of the dimension."""
    rows = table(spark, d, "leads").where("url <> ''").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    counts = joins.with_default(table(spark, d, "source_dim").select("source"), rows, "source", {"n": F.lit(0)})
    return counts.agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.col("source")))), ",").alias("failed"))


@query(
    "budget_guard",
    """select event_id from (select event_id, row_number() over w as nth, coalesce(sum(value) over (partition by cast(ts as date) order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as spent
    from events where ts is not null window w as (partition by cast(ts as date) order by ts, event_id)) where nth <= 300 and spent < 12000""",
)
def budget_guard(spark: SparkSession, d: str) -> DataFrame:
    """Calls that a day's budget lets through: a number of calls and a sum of values, both begun anew each day."""
    rows = table(spark, d, "events").where("ts is not null").select("event_id", "ts", F.col("value"))
    return windows.within_budget(rows, F.to_date("ts"), [F.col("ts"), F.col("event_id")], "value", 300, 12000).select("event_id")


def _ordered(name: str, rows: str, order: list[str], limit: int) -> None:
    """A query for the first rows of an order, given as a list of ``expression [desc]``."""

    @query(name, f"select ordinal, place from (select ordinal, row_number() over (order by {', '.join(order)}, ordinal) as place from records where {rows}) where place <= {limit}")
    def first(spark: SparkSession, d: str) -> DataFrame:
        columns = [F.expr(p.removesuffix(" desc")).desc() if p.endswith(" desc") else F.expr(p).asc() for p in order]
        return orders.first_rows(table(spark, d, "records").where(rows), [*columns, F.asc("ordinal")], limit).select("ordinal", "place")


_ordered("published_order", "true", ["coalesce(score, 0) desc", "coalesce(seen_count, 0) desc", "coalesce(last_seen, '') desc"], 100)
_ordered("push_order", "first_seen <> 'unknown'", ["least(coalesce(score, 0), 95) desc", "coalesce(image, '') <> '' desc", "coalesce(source_family, '') desc", "coalesce(title, '') desc"], 5)
_ordered(
    "scoring_queue", "first_seen is not null",
    ["first_seen = '2026-08-21' desc", "coalesce(score, 0) <= 0 desc", "coalesce(source_type, '') = 'social_signal' desc", "coalesce(seen_count, 0) desc", "coalesce(last_seen, '') desc"], 200,
)
_ordered("image_queue", "coalesce(image, '') = '' and url <> ''", ["coalesce(score, 0) desc", "coalesce(last_seen, '') desc"], 60)


_DAILY = "-coalesce(score, 0), -coalesce(quality_score, 0), -coalesce(innovation, 0), -coalesce(seen_count, 0), coalesce(title, ''), ordinal"


@query("daily_order", f"select ordinal, day, place from (select ordinal, first_seen as day, row_number() over (partition by first_seen order by {_DAILY}) as place from records where first_seen <> 'unknown') where place <= 40")
def daily_order(spark: SparkSession, d: str) -> DataFrame:
    """The first forty rows of each day as they are shown."""
    rows = table(spark, d, "records").where("first_seen <> 'unknown'").withColumn("day", F.col("first_seen"))
    order = [F.expr(f"coalesce({c}, 0)").desc() for c in ("score", "quality_score", "innovation", "seen_count")] + [F.expr("coalesce(title, '')").asc(), F.asc("ordinal")]
    return windows.top_k(rows, ["day"], order, 40, "place").select("ordinal", "day", F.col("place").cast("long").alias("place"))


@query("dashboard_groups", "select day, n from (select first_seen as day, count(*) as n from records where first_seen <> 'unknown' group by 1) order by day desc limit 14")
def dashboard_groups(spark: SparkSession, d: str) -> DataFrame:
    """The latest fourteen days with their rows."""
    return table(spark, d, "records").where("first_seen <> 'unknown'").groupBy(F.col("first_seen").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")).limit(14)


@query(
    "search_order",
    f"""with j as ({catalog.JOBS_SQL}), r as (select *, ((ordinal - 1 - 40) % n + n) % n as turn, case category when '日历' then 0 when '水杯' then 1 when '创意厨具' then 2 else 3 end as priority from (select *, count(*) over () as n from j)),
    k as (select *, row_number() over (partition by category order by priority, turn) as nth from r)
    select category, source, place from (select category, source, row_number() over (order by priority, turn) as place from k where category not in ('手机壳', '充电宝', '冲锋衣') or nth <= 2) where place <= 70""",
)
def search_order(spark: SparkSession, d: str) -> DataFrame:
    """Search jobs of a round: the ring begins at the round's offset, three categories go first, three others give two jobs at most."""
    jobs = catalog.job_matrix(spark, d)
    return orders.search_round(jobs, "category", F.col("ordinal") - 1, 40, {"日历": 0, "水杯": 1, "创意厨具": 2}, {"手机壳": 2, "充电宝": 2, "冲锋衣": 2}, 70).select("category", "source", "place")


@query(
    "round_progress",
    "select batch_no, n, cast(sum(n) over (order by batch_no) - n as bigint) as before from (select batch_no, count(*) as n from leads where batch_no is not null group by 1)",
)
def round_progress(spark: SparkSession, d: str) -> DataFrame:
    """Where each round goes on: the rows that the rounds before it took."""
    counts = table(spark, d, "leads").where("batch_no is not null").groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("before", F.sum("n").over(Window.orderBy("batch_no")) - F.col("n"))  # one row a round
