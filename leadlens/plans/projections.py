"""Queries over projections, dates, names and single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.functions import text, times, url, values
from leadlens.operators import classify
from leadlens.plans import catalog
from leadlens.plans.registry import query
from leadlens.session import table

_CUT_OVER, _TARGET, _LEGACY = "2026-07-20", 40, 30
_WINDOWS = [("09:00", "12:00"), ("14:00", "18:00")]


@query(
    "clean_titles",
    f"select ordinal, {catalog._clean_sql('title')} as title, {catalog._clean_sql('title')} = '{text.UNTITLED}' as untitled from leads",
)
def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles without markup and site name."""
    clean = text.clean_title(F.col("title"))
    return table(spark, d, "leads").select("ordinal", clean.alias("title"), (clean == text.UNTITLED).alias("untitled"))


_CORE = rf"trim(regexp_replace(regexp_replace(lower({catalog.nfkc_sql(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')}), '\b(?:{'|'.join(text.CORE_NOISE)})\b', ' ', 'g'), '[^a-z0-9一-鿿]+', ' ', 'g'))"


@query("core_titles", f"select ordinal, {_CORE} as core from leads")
def core_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").select("ordinal", text.core_title(F.col("title")).alias("core"))


def _candidate_sql(c: str) -> str:
    for marker in text.SITE_SUFFIXES:
        c = f"trim(split_part({c}, '{marker}', 1))"
    for tail in text.SITE_TAILS:
        c = rf"regexp_replace({c}, '(?i)\s+-\s+{tail}$', '')"
    return f"coalesce(nullif({c}, ''), '{text.UNTITLED}')"


@query("candidate_titles", f"select ordinal, {_candidate_sql(chr(116) + 'rim(coalesce(title, ' + chr(39) * 2 + '))')} as title from leads")
def candidate_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").select("ordinal", text.candidate_title(F.col("title")).alias("title"))


@query("short_hashes", "select ordinal, substr(md5(coalesce(url, '')), 1, 12) as md5, substr(sha1(coalesce(url, '')), 1, 16) as sha1 from leads")
def short_hashes(spark: SparkSession, d: str) -> DataFrame:
    page = values.nz(F.col("url"))
    return table(spark, d, "leads").select("ordinal", F.substring(F.md5(page), 1, 12).alias("md5"), text.stable_hash(page, 16).alias("sha1"))


@query("search_urls", "select ordinal, 'https://search.example/?q=' || replace(url_encode(title), '%20', '+') as url from leads where title is not null")
def search_urls(spark: SparkSession, d: str) -> DataFrame:
    found = url.search(F.lit("https://search.example/?q="), F.col("title"))
    return table(spark, d, "leads").where("title is not null").select("ordinal", found.alias("url"))


@query(
    "joined_urls",
    r"""with r as (select ordinal, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) as origin, regexp_replace(url, '[?#].*$', '') as bare, regexp_extract(coalesce(image, ''), '([^/]*)$', 1) as ref from leads where regexp_matches(url, '^https?://'))
    select ordinal, case when regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.\-]*:') then ref when ref = '' then url when starts_with(ref, '?') then bare || ref when starts_with(ref, '#') then regexp_replace(url, '#.*$', '') || ref
      else case when bare = origin then origin || '/' else regexp_replace(bare, '[^/]*$', '') end || ref end as url from r""",
)
def joined_urls(spark: SparkSession, d: str) -> DataFrame:
    """The file name of a lead's image, resolved against the lead's page."""
    rows = table(spark, d, "leads").where(F.col("url").rlike("^https?://"))
    ref = F.regexp_extract(values.nz(F.col("image")), "([^/]*)$", 1)
    return rows.select("ordinal", url.join(F.col("url"), ref).alias("url"))


@query(
    "social_urls",
    rf"""with u as (select ordinal, trim(coalesce(url, '')) as u from leads),
    p as (select ordinal, u, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1) as scheme, lower(regexp_extract(u, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)) as host,
      regexp_replace(regexp_extract(u, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', '') as path,
      list_filter(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+')),
        lambda p: not starts_with(p, 'utm_') and split_part(p, '=', 1) not in ('share_token', 'share_sign', 'xsec_token')) as kept from u)
    select ordinal, lower(scheme) || '://' || host || path || case when len(kept) = 0 then '' else '?' || array_to_string(list_transform(kept, lambda p: replace(url_encode(url_decode(replace(split_part(p, '=', 1), '+', ' '))), '%20', '+') || '=' || replace(url_encode(url_decode(replace(substr(p, instr(p, '=') + 1), '+', ' '))), '%20', '+')), '&') end as url
    from p where lower(scheme) in ('http', 'https')""",
)
def social_urls(spark: SparkSession, d: str) -> DataFrame:
    """Urls of posts: http and https only, without what was added when they were shared."""
    clean = url.social(F.col("url"))
    return table(spark, d, "leads").select("ordinal", clean.alias("url")).where("url <> ''")


@query(
    "clamped_scores",
    """select ordinal, cast(greatest(0, least(10, round_even(coalesce(case when isnan(score) then null else score end, 0), 0))) as int) as score,
      cast(greatest(0, least(10, round_even(case when c > 0 and c <= 1 then c * 10 else c end, 0))) as int) as scaled from (select ordinal, score, coalesce(case when isnan(score) then null else score / 10 end, 0) as c from leads)""",
)
def clamped_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores rounded half to even and kept within 0 and 10; shares of one are taken tenfold."""
    real = F.when(~F.isnan("score"), F.col("score"))
    part = F.coalesce(real / 10, F.lit(0.0))
    return table(spark, d, "leads").select(
        "ordinal", values.clamp(real, 0, 10).alias("score"), values.clamp(F.when((part > 0) & (part <= 1), part * 10).otherwise(part), 0, 10).alias("scaled")
    )


@query(
    "base_scores",
    "select ordinal, cast(greatest(0, least(100, 2 * trunc(coalesce(case when isnan(score) then null else score end, 0) * 5))) as int) as score from leads",
)
def base_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score of ten as one of a hundred: five times, cut to a whole number, doubled, kept within bounds."""
    real = F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(0.0))
    return table(spark, d, "leads").select("ordinal", F.greatest(F.lit(0), F.least(F.lit(100), (real * 5).cast("int") * 2)).alias("score"))


@query(
    "tag_tests",
    "select ordinal, len(list_filter(coalesce(tags, []), lambda t: contains(t, 'a'))) > 0 as any_a, len(list_filter(coalesce(tags, []), lambda t: length(t) > 1)) = len(coalesce(tags, [])) as all_long from leads where len(list_filter(coalesce(tags, []), lambda t: t is null)) = 0",
)
def tag_tests(spark: SparkSession, d: str) -> DataFrame:
    """Whether some tag has a letter a, and whether every tag has two characters."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    rows = table(spark, d, "leads").where(~F.exists(tags, lambda t: t.isNull()))
    return rows.select("ordinal", F.exists(tags, lambda t: F.contains(t, F.lit("a"))).alias("any_a"), F.forall(tags, lambda t: F.length(t) > 1).alias("all_long"))


@query(
    "merged_maps",
    """select ordinal, array_to_string(list_sort(['innovation=' || coalesce(cast(innovation as varchar), ''), 'quality=' || coalesce(cast(coalesce(quality_score, score) as varchar), ''), 'seen=' || coalesce(cast(seen_count as varchar), '')]), ',') as entries from records""",
)
def merged_maps(spark: SparkSession, d: str) -> DataFrame:
    """Two maps as one, the later one's values win unless null; entries by key."""
    old = F.create_map(F.lit("quality"), F.col("score"), F.lit("seen"), F.col("seen_count"))
    new = F.create_map(F.lit("quality"), F.coalesce("quality_score", "score"), F.lit("innovation"), F.col("innovation"))
    rows = table(spark, d, "records").select("ordinal", values.map_update(old, new).alias("m"))
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit(""))))
    return rows.select("ordinal", F.array_join(entries, ",").alias("entries"))


@query("day_targets", f"select ordinal, case when regexp_full_match(first_seen, '\\d{{4}}-\\d{{2}}-\\d{{2}}') and first_seen >= '{_CUT_OVER}' then {_TARGET} else {_LEGACY} end as target from records")
def day_targets(spark: SparkSession, d: str) -> DataFrame:
    """How many rows a day should have: more from a date on."""
    return table(spark, d, "records").select("ordinal", times.day_target(F.col("first_seen"), _CUT_OVER, _TARGET, _LEGACY).alias("target"))


@query(
    "clock_windows",
    """with t as (select ordinal, cast(extract(hour from created_at) * 60 + extract(minute from created_at) as int) as m, extract(hour from created_at) * 3600 + extract(minute from created_at) * 60 + floor(extract(second from created_at)) as s from feedback_events where created_at is not null)
    select ordinal, case when s between 32400 and 43020 then '09:00-12:00' when s between 50400 and 64620 then '14:00-18:00' else '' end as open,
      cast(case when s between 32400 and 43020 then floor((43020 - s) / 60) when s between 50400 and 64620 then floor((64620 - s) / 60) else 0 end as int) as minutes from t""",
)
def clock_windows(spark: SparkSession, d: str) -> DataFrame:
    """In which window of the day an event lies, closed three minutes before its end, and the minutes left."""
    opened, left = times.clock_window(F.col("created_at"), _WINDOWS, 3)
    return table(spark, d, "feedback_events").where("created_at is not null").select("ordinal", opened.alias("open"), left.alias("minutes"))


@query("weekdays", "select ordinal, cast(isodow(added) - 1 as int) as weekday, isodow(added) <= 5 as workday, cast(added + case isodow(added) when 5 then 3 when 6 then 2 else 1 end as date) as next from leads where added is not null")
def weekdays(spark: SparkSession, d: str) -> DataFrame:
    """Day of the week (Monday 0), whether it is a working day, and the next working day."""
    added = F.col("added")
    rows = table(spark, d, "leads").where("added is not null")
    return rows.select("ordinal", F.weekday(added).alias("weekday"), (F.weekday(added) < 5).alias("workday"), times.next_workday(added).alias("next"))


@query("run_buckets", "select case when h < 11 then 0 when h < 16 then 1 else 2 end as bucket, count(*) as n from (select extract(hour from created_at) as h from feedback_events where created_at is not null) group by 1")
def run_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Events by the run of the day that they fall into."""
    hour = F.hour("created_at")
    return table(spark, d, "feedback_events").where("created_at is not null").groupBy(F.when(hour < 11, 0).when(hour < 16, 1).otherwise(2).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_FAMILIES = "case source_type when 'social_signal' then 'social' when 'verified_official' then 'award' when 'editorial_source' then 'media' when 'packaging_source' then 'packaging' when 'design_community' then 'community' when 'market_reference' then case when quality = 'weak' then 'weak market' else 'market' end when 'trend_source' then case when quality = 'weak' then 'weak market' else 'trend' end else 'other' end"


@query(
    "source_families",
    f"""with q as (select l.ordinal, coalesce(nullif(l.source_type, ''), s.source_type, 'public_web') as source_type, lower(trim(l.quality_tier)) as tier, lower(l.source_group) as grp, s.quality as named from leads l left join source_dim s on l.source = s.source),
    r as (select ordinal, source_type, case when tier in ('premium', 'standard', 'weak') then tier when contains(grp, 'weak') then 'weak' when contains(grp, 'strong') then 'standard' when named is not null then named
      when source_type in ('verified_official', 'editorial_source', 'packaging_source') then 'premium' when source_type = 'trend_source' then 'weak' else 'standard' end as quality from q)
    select ordinal, source_type, quality, {_FAMILIES} as family from r""",
)
def source_families(spark: SparkSession, d: str) -> DataFrame:
    """Type, quality and family of a lead's source: own value, else the dimension's, else by type."""
    dim = table(spark, d, "source_dim").select("source", F.col("source_type").alias("_type"), F.col("quality").alias("_quality"))
    rows = table(spark, d, "leads").select("ordinal", "source", "source_type", "quality_tier", "source_group").join(dim, "source", "left")
    rows = rows.withColumn("source_type", F.coalesce(F.nullif("source_type", F.lit("")), "_type", F.lit("public_web")))
    rows = rows.withColumn("quality", classify.source_quality(F.col("quality_tier"), F.col("source_group"), F.col("_quality"), F.col("source_type")))
    return rows.select("ordinal", "source_type", "quality", classify.source_family(F.col("source_type"), F.col("quality")).alias("family"))


@query("score_threshold", "select ordinal from leads where score * 10 >= 35 and not isnan(score)")
def score_threshold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").where("score * 10 >= 35 and not isnan(score)").select("ordinal")


@query(
    "weekly_items",
    """select ordinal, id, coalesce(title, '') as title, coalesce(category, 'none') as category, coalesce(action_lane, 'reference') as lane, coalesce(nullif(quality_score, 0), score, 0) as score,
      format('{:.1f}', coalesce(nullif(quality_score, 0), score, 0) / 10.0) as label, coalesce(nullif(source_name, ''), 'unknown') as source, array_to_string(coalesce(axes, [])[1:6], ',') as axes from records""",
)
def weekly_items(spark: SparkSession, d: str) -> DataFrame:
    """Records as rows of a weekly report."""
    score = F.coalesce(F.nullif("quality_score", F.lit(0)), "score", F.lit(0))
    return table(spark, d, "records").select(
        "ordinal", "id", values.nz(F.col("title")).alias("title"), F.coalesce("category", F.lit("none")).alias("category"), F.coalesce("action_lane", F.lit("reference")).alias("lane"),
        score.alias("score"), F.format_string("%.1f", score / F.lit(10.0)).alias("label"), values.nz(F.col("source_name"), "unknown").alias("source"),
        F.array_join(F.slice(F.coalesce("axes", F.array().cast("array<string>")), 1, 6), ",").alias("axes"),
    )


@query(
    "lead_rows",
    f"""with {catalog._PARTS}, x as (select l.*, c.url as page, {catalog._clean_sql('title')} as clean from leads l join canon c using (ordinal))
    select ordinal, coalesce(nullif(id, ''), substr(sha1(case when page <> '' then page else clean || '|' || coalesce(category, 'none') end), 1, 12)) as id, clean as title, coalesce(category, 'none') as category,
      coalesce(nullif(source, ''), 'unknown') as source, page as url, coalesce(likes, 0) as likes, len(coalesce(tags, [])) as tags from x""",
)
def lead_rows(spark: SparkSession, d: str) -> DataFrame:
    """Leads in one form: id or a hash of page or title, clean title, canonical page, defaults."""
    category = F.coalesce("category", F.lit("none"))
    rows = table(spark, d, "leads").withColumns({"_page": url.canonical(F.col("url")), "_clean": text.clean_title(F.col("title"))})
    own = text.stable_hash(F.when(F.col("_page") != "", F.col("_page")).otherwise(F.concat("_clean", F.lit("|"), category)))
    return rows.select(
        "ordinal", values.nz(F.col("id"), own).alias("id"), F.col("_clean").alias("title"), category.alias("category"), values.nz(F.col("source"), "unknown").alias("source"),
        F.col("_page").alias("url"), F.coalesce("likes", F.lit(0)).alias("likes"), F.coalesce(F.array_size("tags"), F.lit(0)).cast("long").alias("tags"),
    )


@query(
    "source_records",
    f"""with {catalog._PARTS} select l.ordinal, coalesce(nullif(l.source, ''), 'unknown') as source, coalesce(nullif(l.source_type, ''), s.source_type, 'public_web') as source_type, c.url, coalesce(l.image, '') as image, coalesce(l.likes, 0) as likes,
      coalesce(l.collected_at, l.added) as collected_at from leads l join canon c using (ordinal) left join source_dim s on l.source = s.source""",
)
def source_records(spark: SparkSession, d: str) -> DataFrame:
    """What a product keeps of each lead: source, page, image, likes and day."""
    dim = table(spark, d, "source_dim").select("source", F.col("source_type").alias("_type"))
    rows = table(spark, d, "leads").join(dim, "source", "left")
    return rows.select(
        "ordinal", values.nz(F.col("source"), "unknown").alias("source"), F.coalesce(F.nullif("source_type", F.lit("")), "_type", F.lit("public_web")).alias("source_type"),
        url.canonical(F.col("url")).alias("url"), values.nz(F.col("image")).alias("image"), F.coalesce("likes", F.lit(0)).alias("likes"), F.coalesce("collected_at", "added").alias("collected_at"),
    )


@query(
    "review_payload",
    "select ordinal, substr(coalesce(title, ''), 1, 80) as title, substr(coalesce(reason, ''), 1, 200) as reason, array_to_string(coalesce(tags, [])[1:3], ',') as tags from leads",
)
def review_payload(spark: SparkSession, d: str) -> DataFrame:
    """Leads cut to the lengths that a reviewer is sent."""
    tags = F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 3), ",")
    return table(spark, d, "leads").select("ordinal", F.substring(values.nz(F.col("title")), 1, 80).alias("title"), F.substring(values.nz(F.col("reason")), 1, 200).alias("reason"), tags.alias("tags"))


@query(
    "candidate_leads",
    "select ordinal, substr(sha1(source || '|' || coalesce(url, '')), 1, 12) as id, source, array_to_string(list_filter([category, source, 'public'], lambda x: x is not null), ',') as tags, coalesce(search_intent, 'discover') as intent from leads where source <> ''",
)
def candidate_leads(spark: SparkSession, d: str) -> DataFrame:
    """Search results as leads: id of source and page, tags and intent."""
    key = text.stable_hash(F.concat("source", F.lit("|"), values.nz(F.col("url"))))
    tags = F.concat_ws(",", "category", "source", F.lit("public"))
    return table(spark, d, "leads").where("source <> ''").select("ordinal", key.alias("id"), "source", tags.alias("tags"), F.coalesce("search_intent", F.lit("discover")).alias("intent"))


@query(
    "report_rows",
    "select strftime(cast(first_seen as date), '%G-W%V') as week, count(*) as actual, 100 as target, min(first_seen) as date_start, max(first_seen) as date_end from records where regexp_full_match(first_seen, '\\d{4}-\\d{2}-\\d{2}') group by 1",
)
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Weekly reports in short: week, rows, target and first and last day."""
    rows = table(spark, d, "records").where(F.col("first_seen").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return rows.groupBy(values.iso_week(F.to_date("first_seen")).alias("week")).agg(
        F.count(F.lit(1)).alias("actual"), F.lit(100).alias("target"), F.min("first_seen").alias("date_start"), F.max("first_seen").alias("date_end")
    )


@query("item_snapshots", "select ordinal, cast(to_json({'title': title, 'category': category, 'url': url, 'source_name': source_name, 'source_family': source_family, 'action_lane': action_lane}) as varchar) as snapshot from records")
def item_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """What a feedback event keeps of an item, as JSON with nulls."""
    item = F.struct("title", "category", "url", "source_name", "source_family", "action_lane")
    return table(spark, d, "records").select("ordinal", F.to_json(item, {"ignoreNullFields": "false"}).alias("snapshot"))


@query("identity_sets", r"""select ordinal, array_to_string(list_filter([coalesce(id, ''), substr(regexp_replace(regexp_replace(lower(coalesce(url, '')), 'https?://', '', 'g'), '[^a-z0-\x5c]+', '', 'g'), 1, 120), substr(regexp_replace(regexp_replace(lower(coalesce(title, '')), 'https?://', '', 'g'), '[^a-z0-\x5c]+', '', 'g'), 1, 120)], lambda x: x <> ''), ' ') as keys from records""")
def identity_sets(spark: SparkSession, d: str) -> DataFrame:
    """All keys of a row: id, key of the url and key of the title; rows that share one are duplicates in selections."""
    return table(spark, d, "records").select("ordinal", F.array_join(text.row_keys(F.col("id"), F.col("url"), F.col("title")), " ").alias("keys"))


@query("usable_urls", "select ordinal, coalesce(nullif(url, ''), nullif(image, '')) as url, coalesce(nullif(source_name, ''), nullif(source_family, ''), 'other') as label from records")
def usable_urls(spark: SparkSession, d: str) -> DataFrame:
    """The first usable url of a row and the label of its source."""
    return table(spark, d, "records").select(
        "ordinal", values.first_nonempty(F.col("url"), F.col("image")).alias("url"), F.coalesce(values.first_nonempty(F.col("source_name"), F.col("source_family")), F.lit("other")).alias("label")
    )


@query("latest_day", "select max(first_seen) as day, arg_max(id, (first_seen, -ordinal)) as id from records where try_cast(first_seen as date) is not null")
def latest_day(spark: SparkSession, d: str) -> DataFrame:
    """The latest day and its first row; what is no date is left out."""
    rows = table(spark, d, "records").where(F.try_to_date("first_seen").isNotNull())
    return rows.agg(F.max("first_seen").alias("day"), F.max_by("id", F.struct("first_seen", -F.col("ordinal"))).alias("id"))


@query(
    "first_json_block",
    r"select doc_id, try_cast(json_extract_string(b, '$.score') as double) as score, length(b) as size from (select doc_id, regexp_extract(text, '(?s)\{.*\}', 0) as b from documents) where b <> '' and json_valid(b)",
)
def first_json_block(spark: SparkSession, d: str) -> DataFrame:
    """The text from the first to the last brace of a document, where it is JSON."""
    block = F.regexp_extract("text", r"(?s)\{.*\}", 0)
    rows = table(spark, d, "documents").select("doc_id", block.alias("b")).where("b <> ''").withColumn("v", F.try_parse_json("b"))
    return rows.where("v is not null").select("doc_id", F.get_json_object("b", "$.score").try_cast("double").alias("score"), F.length("b").cast("long").alias("size"))
