"""Queries over scalar functions, filters, look-ups and classification."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadlens.functions import identity, text, unify, url, values
from leadlens.operators import classify, joins
from leadlens.plans.registry import query
from leadlens.session import small_rows, table

#: Example keyword table, rules and words of the classification queries.
KEYWORDS = {"drinkware": ["mug", "tumbler", "bottle", "杯", "壶"], "light": ["lamp", "lantern", "灯"], "gift": ["box", "礼盒"], "power": ["power bank", "charger", "充电宝"]}
RULES = [("cover", ["phone case", "手机壳"], ["only", "配件"]), ("board", ["board", "砧板", "切菜板"], ["calendar"]), ("steel", ["stainless steel", "不锈钢"], [])]
PATTERNS = [("measure_volume", r"[0-9](ml|l| ml| l)([^a-z]|$)"), ("measure_light", r"[0-9] ?-?(lm|lumen)"), ("measure_length", r"[0-9] ?-?(mm|cm|in)")]
STRONG, WEAK = ["magnetic", "folding", "可换", "磁吸", "reusable", "hinge"], ["viral", "爆款", "must-have"]


def _sql_hits(c: str, words: list[str]) -> str:
    return "(" + " + ".join(f"cast(contains({c}, '{w.lower()}') as int)" for w in words) + ")"


_PARTS = r"""
parts as (
  select ordinal, trim(replace(replace(replace(replace(replace(replace(coalesce(url, ''), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) as u, source
  from leads),
pieces as (
  select ordinal, source, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) as scheme, lower(regexp_extract(u, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)) as host,
    regexp_replace(regexp_extract(u, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', '') as path,
    list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+')) as pairs
  from parts),
canon as (
  select ordinal, source, host, path, case when u = '' then '' else case when scheme = '' then 'https' else scheme end || case when host = '' and regexp_matches(path, '^[^/]') then ':' else '://' end || host || path ||
    case when len(kept) = 0 then '' else '?' || array_to_string(list_transform(kept, lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&') end end as url
  from (select *, list_filter(list_transform(pairs, lambda p: {'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'v': url_decode(replace(substr(p, instr(p, '=') + 1), '+', ' '))}), lambda p: not starts_with(p.k, 'utm_') and p.k not in
    ('spm', 'fbclid', 'gclid', 'xsec_token', 'xsec_source', 'share_from_user_hidden', 'share_id', 'share_sign', 'timestamp')) as kept from pieces))
"""


@query("url_canonicalize", f"with {_PARTS} select ordinal, url from canon")
def url_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").select("ordinal", url.canonical(F.col("url")).alias("url"))


_SEG = ", ".join(f"'{s}'" for s in url.LISTING_SEGMENTS)


@query(
    "url_item_gate",
    rf"""with {_PARTS}, seg as (select ordinal, url, list_filter(string_split(lower(path), '/'), lambda s: s <> '') as s,
      list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+')), lambda p: lower(split_part(p, '=', 1))) as keys from canon)
    select ordinal, url from seg where regexp_matches(url, '^https?://[^/?#]') and not regexp_matches(url, '^https?://[^/?#]*(duckduckgo|google|bing|baidu)\.com($|[/?#])') and not (list_has_any(keys, ['q', 'query', 'keyword', 'keywords', 'search', 's', 'wd', 'k'])
      or coalesce(s[-1] in ({_SEG}), false) or (list_has_any(s[1:2], [{_SEG}]) and len(s) <= 3))""",
)
def url_item_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").select("ordinal", url.direct(F.col("url")).alias("url")).where("url <> ''")


@query(
    "url_domain_source",
    f"""with {_PARTS} select ordinal, host, domain, named from (select c.ordinal, c.host, m.domain, m.source as named, row_number() over (partition by c.ordinal order by length(m.domain) desc, m.ord) as n
    from canon c join domain_dim m on c.host = m.domain or ends_with(c.host, '.' || m.domain)) where n = 1""",
)
def url_domain_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "leads").select("ordinal", url.host(url.canonical(F.col("url"))).alias("host"))
    domains = table(spark, d, "domain_dim").select("domain", "ord", F.col("source").alias("named"))
    return joins.by_domain(rows, "host", domains, "domain", "ord").select("ordinal", "host", "domain", "named")


_STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\s\p{{Z}}]+', ' ', 'g'))"""


@query("html_strip", f"select doc_id, {_STRIP.format(c='text')} as text from documents")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.strip_html(F.col("text")).alias("text"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@functools.cache
def _compatible() -> tuple[str, str, dict[str, str]]:
    """(seen, meant) of single characters in compatibility form, and those that are spelled with several, as far as the tables hold them."""
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]}
    single = {c: f for c, f in forms.items() if len(f) == 1 and f != c}
    return "".join(single), "".join(single.values()), {c: forms[c] for c in [*unify.EXPANSIONS, *unify.UNIT_SIGNS]}


def nfkc_sql(c: str) -> str:
    seen, meant, several = _compatible()
    for sign, spelled in several.items():
        c = f"replace({c}, {_text(sign)}, {_text(spelled)})"
    return f"nfc_normalize(translate({c}, {_text(seen)}, {_text(meant)}))"


_PREFIXES = "|".join(p.replace("'", "''") for p in text.SITE_PREFIXES)


def _clean_sql(c: str) -> str:
    return rf"coalesce(nullif(trim(regexp_replace({_STRIP.format(c=c)}, '(?i)^(?:{_PREFIXES})[\s\p{{Z}}]*[·:\-|][\s\p{{Z}}]*', '')), ''), '{text.UNTITLED}')"


def _norm_sql(c: str) -> str:
    out = rf"regexp_replace({nfkc_sql(f'lower({_clean_sql(c)})')}, 'https?://\S+', ' ', 'g')"
    for w in text.NOISE:
        out = f"replace({out}, '{w}', ' ')"
    return rf"trim(regexp_replace(regexp_replace({out}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


_WEAK = ", ".join(f"'{w}'" for w in text.WEAK)


def _tokens_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all({c}, '([a-z0-9]+|[一-鿿]{{2,}})', 1), lambda t: length(t) >= 2 and t not in ({_WEAK}))"


@query("text_normalize", f"select ordinal, {_norm_sql('title')} as title from leads")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").select("ordinal", text.normalize(F.col("title")).alias("title"))


@query("content_tokens", f"select ordinal, array_to_string({_tokens_sql(_norm_sql('title'))}, ' ') as tokens from leads")
def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = text.content_tokens(text.normalize(F.col("title")))
    return table(spark, d, "leads").select("ordinal", F.array_join(tokens, " ").alias("tokens"))


_NOISE = ", ".join(f"'{w}'" for w in text.TITLE_NOISE)
_TITLE_TOKENS = rf"""list_filter(list_transform(list_filter(string_split(trim(regexp_replace(lower({nfkc_sql("coalesce(title, '')")}), '[^a-z0-9一-鿿]+', ' ', 'g')), ' '), lambda t: t <> '' and t not in ({_NOISE})),
  lambda t: case when ends_with(t, 'ing') and length(t) > 5 then substr(t, 1, length(t) - 3) when ends_with(t, 'ies') and length(t) > 5 then substr(t, 1, length(t) - 3) || 'y'
    when ends_with(t, 's') and length(t) > 4 then substr(t, 1, length(t) - 1) else t end), lambda t: t <> '' and t not in ({_NOISE}))"""


@query("title_tokens", f"select ordinal, array_to_string({_TITLE_TOKENS}, ' ') as tokens from leads")
def title_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").select("ordinal", F.array_join(text.title_tokens(F.col("title")), " ").alias("tokens"))


_FINGERPRINT = f"""norms as (select ordinal, coalesce(nullif(category, ''), 'none') as category, coalesce(nullif(url, ''), title, '') as last, coalesce(title, '') as title,
      {_norm_sql('title')} as n1, {_norm_sql("(coalesce(title, '') || ' ' || coalesce(creator, ''))")} as n2,
      {_norm_sql("(coalesce(title, '') || ' ' || coalesce(reason, '') || ' ' || coalesce(creator, ''))")} as n3 from leads),
  tokens as (select *, {_tokens_sql('n1')} as t1, {_tokens_sql('n2')} as t2, {_tokens_sql('n3')} as t3 from norms),
  prints as (select ordinal, category || ':' || substr(sha1(coalesce(nullif(array_to_string(case when len(t2) < 2 then t3[1:8] else t2[1:8] end, ''), ''), nullif(n1, ''), last)), 1, 16) as fingerprint,
    category || ':' || substr(sha1(coalesce(nullif(array_to_string(t1[1:8], ''), ''), substr(sha1(title), 1, 12))), 1, 16) as product_key from tokens)"""


@query("content_fingerprint", f"with {_FINGERPRINT} select ordinal, fingerprint, product_key from prints")
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return with_fingerprints(table(spark, d, "leads")).select("ordinal", "fingerprint", "product_key")


def with_fingerprints(leads: DataFrame) -> DataFrame:
    """Leads with content fingerprint and product key."""
    return text.with_fingerprints(leads, values.nz(F.col("category"), "none"), F.col("title"), F.col("reason"), F.col("creator"), F.col("url"))


@query("stable_hash", "select ordinal, substr(sha1(coalesce(url, '') || '|' || coalesce(title, '')), 1, 12) as key from leads")
def stable_hash(spark: SparkSession, d: str) -> DataFrame:
    joined = F.concat(values.nz(F.col("url")), F.lit("|"), values.nz(F.col("title")))
    return table(spark, d, "leads").select("ordinal", text.stable_hash(joined).alias("key"))


@query(
    "compat_key",
    r"select ordinal, substr(regexp_replace(lower(coalesce(title, '')), '[^a-z0-\x5c]+', '', 'g'), 1, 120) as key, case when length(title) > 20 then rtrim(substr(title, 1, 19), ' ') || '…' else title end as short from leads",
)
def compat_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").select("ordinal", text.compat_key(F.col("title")).alias("key"), text.truncate(F.col("title"), 20).alias("short"))


_LOW = "lower(coalesce(title, '') || ' ' || coalesce(reason, ''))"


@query(
    "keyword_score",
    f"""select ordinal, cast(6 + least(cast(trunc(1.5 * strong) as int), 4) - least(cast(trunc(1.5 * weak) as int), 3) as int) as score from (
    select ordinal, {_sql_hits(_LOW, STRONG)} as strong, {_sql_hits(_LOW, WEAK)} as weak from leads)""",
)
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws(" ", values.nz(F.col("title")), values.nz(F.col("reason")))
    strong, weak = values.hits(body, STRONG), values.hits(body, WEAK)
    score = F.lit(6) + F.least((strong * 1.5).cast("int"), F.lit(4)) - F.least((weak * 1.5).cast("int"), F.lit(3))
    return table(spark, d, "leads").select("ordinal", score.cast("int").alias("score"))


@query(
    "weighted_score",
    "select ordinal, cast(round_even(coalesce(quality_score, 0) * 0.5 + coalesce(innovation, 0) * 3.0 + coalesce(relevance, 0) * 2.0, 0) as int) as score from records",
)
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    terms = [(F.col("quality_score"), 0.5), (F.col("innovation"), 3.0), (F.col("relevance"), 2.0)]
    return table(spark, d, "records").select("ordinal", values.weighted(terms).alias("score"))


@query(
    "score_buckets",
    "select bucket, count(*) as n from (select case when score >= 90 then 'top' when score >= 75 then 'good' when score >= 60 then 'fair' else 'low' end as bucket from records) group by bucket",
)
def score_buckets(spark: SparkSession, d: str) -> DataFrame:
    name = values.bucket(F.col("score"), [(90, "top"), (75, "good"), (60, "fair")], "low")
    return table(spark, d, "records").groupBy(name.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_SCORED = ", ".join(f"({_sql_hits(_LOW, w)}, {-i}, '{c}')" for i, (c, w) in enumerate(KEYWORDS.items()))


@query(
    "keyword_category",
    f"""with h as (select ordinal, {', '.join(f'{_sql_hits(_LOW, w)} as {c}' for c, w in KEYWORDS.items())} from leads), m as (select *, greatest({', '.join(KEYWORDS)}) as best from h)
    select ordinal, case when best = 0 then null {' '.join(f"when {c} = best then '{c}'" for c in KEYWORDS)} end as class from m""",
)
def keyword_category(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws(" ", values.nz(F.col("title")), values.nz(F.col("reason")))
    return table(spark, d, "leads").select("ordinal", classify.most_hits(body, KEYWORDS).alias("class"))


def _rule_sql(words: list[str], excluded: list[str]) -> str:
    return f"{_sql_hits(_LOW, words)} > 0" + (f" and {_sql_hits(_LOW, excluded)} = 0" if excluded else "")


@query("rule_category", "select ordinal, case " + " ".join(f"when {_rule_sql(w, x)} then '{c}'" for c, w, x in RULES) + " end as class from leads")
def rule_category(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws(" ", values.nz(F.col("title")), values.nz(F.col("reason")))
    return table(spark, d, "leads").select("ordinal", classify.first_rule(body, RULES).alias("class"))


@query("pattern_category", "select ordinal, case " + " ".join(f"when regexp_matches(lower(coalesce(title, '')), '{p}') then '{c}'" for c, p in PATTERNS) + " end as class from leads")
def pattern_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").select("ordinal", classify.first_pattern(F.col("title"), PATTERNS).alias("class"))


@query(
    "topic_labels",
    "select ordinal, array_to_string(case when len(l) = 0 then ['other'] else l[1:2] end, ',') as labels from (select ordinal, list_filter(["
    + ", ".join(f"case when {_sql_hits(_LOW, w)} > 0 then '{c}' end" for c, w in KEYWORDS.items())
    + "], lambda x: x is not null) as l from leads)",
)
def topic_labels(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws(" ", values.nz(F.col("title")), values.nz(F.col("reason")))
    return table(spark, d, "leads").select("ordinal", F.array_join(classify.labels(body, KEYWORDS, 2, "other"), ",").alias("labels"))


@query(
    "source_quality",
    """select ordinal, coalesce(case when lower(trim(quality_tier)) in ('premium', 'standard', 'weak') then lower(trim(quality_tier)) end,
      case when contains(lower(source_group), 'weak') then 'weak' when contains(lower(source_group), 'strong') then 'standard' end, s.quality, 'standard') as quality
    from leads l left join source_dim s on l.source = s.source""",
)
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    tier, group = F.lower(F.trim("quality_tier")), F.lower("source_group")
    direct = F.when(tier.isin("premium", "standard", "weak"), tier)
    by_group = F.when(F.contains(group, F.lit("weak")), "weak").when(F.contains(group, F.lit("strong")), "standard")
    rows = table(spark, d, "leads").select("ordinal", "source", direct.alias("a"), by_group.alias("b"))
    joined = rows.join(table(spark, d, "source_dim").select("source", "quality"), "source", "left")
    return joined.select("ordinal", F.coalesce("a", "b", "quality", F.lit("standard")).alias("quality"))


@query(
    "facet_filter",
    "select ordinal from records where action_lane is not null and source_family = '媒体案例' and contains(lower(concat_ws(' ', title, summary, source_name)), 'box')",
)
def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    whole = F.lower(F.concat_ws(" ", "title", "summary", "source_name"))
    return table(spark, d, "records").where(F.col("action_lane").isNotNull() & (F.col("source_family") == "媒体案例") & F.contains(whole, F.lit("box"))).select("ordinal")


@query("json_block", r"""select doc_id, json_extract_string(b, '$.id') as id, cast(json_extract(b, '$.score') as double) as score from (
  select doc_id, regexp_extract(text, '(?s)\{"id".*?\}', 0) as b from documents) where b <> '' and json_valid(b)""")
def json_block(spark: SparkSession, d: str) -> DataFrame:
    block = F.regexp_extract("text", r'(?s)\{"id".*?\}', 0)
    rows = table(spark, d, "documents").select("doc_id", block.alias("b"), F.from_json(block, "id string, score double").alias("j"))
    return rows.where("b <> '' and j.id is not null").select("doc_id", "j.id", "j.score")


@query("image_url", r"""select ordinal, case when regexp_matches(f, '(?i)^https?://') and not regexp_matches(f, '(?i)(placeholder|spacer|blank\.gif|favicon|1x1)') then f else '' end as image
from (select ordinal, case when starts_with(image, '//') then 'https:' || image else image end as f from leads)""")
def image_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").select("ordinal", url.image(F.col("image")).alias("image"))


@query("iso_week", """select ordinal, strftime(added, '%G-W%V') as week, cast(date_trunc('week', added) as date) as monday, cast(date_trunc('week', added) as date) + 6 as sunday from leads where added is not null""")
def iso_week(spark: SparkSession, d: str) -> DataFrame:
    monday, sunday = values.week_range(F.col("added"))
    rows = table(spark, d, "leads").where("added is not null")
    return rows.select("ordinal", values.iso_week(F.col("added")).alias("week"), monday.alias("monday"), sunday.alias("sunday"))


JOBS_SQL = "select c.category, s.source, row_number() over (order by s.source, c.category) as ordinal from (select distinct category from sample_targets) c, source_dim s"


@query("job_matrix", JOBS_SQL)
def job_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every listed category with every source: a cross join of two fixed dimensions, whose sizes are checked."""
    categories = small_rows(table(spark, d, "sample_targets").select("category").distinct(), 1000)
    sources = table(spark, d, "source_dim").select("source")
    small_rows(sources, 1000)
    pairs = sources.crossJoin(spark.createDataFrame(categories, "category string"))
    return pairs.select("category", "source", F.row_number().over(Window.orderBy("source", "category")).cast("long").alias("ordinal"))


#: Example tables of the identity keys: brands with concepts and their markers by category, and known names with their words.
FAMILIES = {"手机壳": (["halden", "lumaro", "vesolt"], {"stand": ["tilt stand", "倾斜支架"]})}
NAMED = {"halden-rasizaho": ["halden", "rasizaho"]}


def _named_sql(c: str) -> str:
    noise = ", ".join(repr(w) for w in identity.COMMON)
    words = f"list_transform(regexp_extract_all(coalesce({c}, ''), '([A-Za-z][A-Za-z0-9-]{{2,}})', 1), lambda w: {{'raw': w, 'word': lower(replace(w, '-', ''))}})"
    return f"list_filter({words}, lambda p: length(p.word) >= 3 and p.word not in ({noise}))"


def _stylised_sql(r: str) -> str:
    return f"(regexp_matches({r}, '[0-9]') or (regexp_matches({r}, '^.+[A-Z]') and {r} <> upper({r})) or {r} = upper({r}) or length({r}) >= 7)"


_FAMILY_SQL = ", ".join(
    f"case when category = '{c}' and brand in ({', '.join(map(repr, brands))}) and ({' or '.join(f'contains(lower(whole), {m!r})' for m in markers)}) then 'family:' || category || ':' || brand || ':{concept}' end"
    for c, (brands, concepts) in FAMILIES.items() for concept, markers in concepts.items()
)
_NAMED_SQL = ", ".join(f"case when {' and '.join(f'list_contains(held, {w!r})' for w in words)} then 'named:' || category || ':{name}' end" for name, words in NAMED.items())
_IDENTITY = f"""texts as (select ordinal, coalesce(nullif(category, ''), 'none') as category, product_identity as explicit, {_clean_sql('title')} as clean,
      substr(regexp_replace(coalesce(reason, ''), '(?is)(页面证据|page evidence).*$', ''), 1, 320) as short from leads),
  wholes as (select ordinal, category, explicit, {nfkc_sql('clean')} as clean, {nfkc_sql("trim(trim(coalesce(explicit, '')) || ' ' || clean || ' ' || short)")} as whole from texts),
  found as (select ordinal, category, whole, {_named_sql('explicit')} as e, {_named_sql('clean')} as c, {_named_sql('whole')} as w from wholes),
  branded as (select *, list_transform(e, lambda p: p.word) as g0, list_transform(w, lambda p: p.word) as h0,
      coalesce(e[1].word, c[1].word, list_filter(w, lambda p: p.raw = upper(p.raw))[1].word, '') as brand from found),
  modelled as (select *, list_filter(g0, lambda x, i: list_position(g0, x) = i) as g, list_filter(h0, lambda x, i: list_position(h0, x) = i)[1:14] as held,
      list_filter(w, lambda p: p.word = brand)[1].raw as brand_raw, list_filter(w, lambda p: p.word <> brand)[1] as model from branded),
  identities as (select ordinal, list_filter([case when len(g) >= 2 then 'explicit:' || category || ':' || array_to_string(g[1:4], ':') end,
      case when len(g) >= 2 then 'explicit-core:' || category || ':' || array_to_string(g[1:3], ':') end,
      case when brand <> '' and model is not null and (coalesce({_stylised_sql('brand_raw')} and brand_raw <> upper(brand_raw), false) or {_stylised_sql('model.raw')}) then 'identity:' || category || ':' || brand || ':' || model.word end,
      {_FAMILY_SQL}, {_NAMED_SQL}], lambda k: k is not null) as keys from modelled)"""


def with_entity_keys(leads: DataFrame, out: str = "keys") -> DataFrame:
    """Leads with their identity keys."""
    category = values.nz(F.col("category"), "none")
    return identity.with_keys(leads, category, F.col("title"), F.col("product_identity"), F.col("reason"), out, FAMILIES, NAMED)


@query("identity_keys", f"with {_IDENTITY} select ordinal, array_to_string(keys, ' ') as keys from identities")
def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    return with_entity_keys(table(spark, d, "leads")).select("ordinal", F.array_join("keys", " ").alias("keys"))


@query("identity_groups", f"with {_IDENTITY} select key, count(*) as n, min(ordinal) as first from (select ordinal, unnest(keys) as key from identities) group by key having count(*) > 1")
def identity_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every identity key that several leads share, with their number and the first of them: an equi-join key, not pairs."""
    each = with_entity_keys(table(spark, d, "leads")).select("ordinal", F.explode("keys").alias("key"))
    return each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first")).where("n > 1")


@query("like_counts", r"""select ordinal, cast(coalesce(try_cast(nullif(regexp_extract(lower(reason), '(\d+(?:\.\d+)?)\s*(万|w|k)?', 1), '') as double) *
  case when regexp_extract(lower(reason), '(\d+(?:\.\d+)?)\s*(万|w|k)?', 2) in ('万', 'w') then 10000 when regexp_extract(lower(reason), '(\d+(?:\.\d+)?)\s*(万|w|k)?', 2) = 'k' then 1000 else 1 end, 0) - 0.0 as double) as n from leads""")
def like_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").select("ordinal", text.like_value(F.col("reason")).alias("n"))
