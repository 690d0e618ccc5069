"""SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

import re

from leadlens.functions import unify


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _class(java: str) -> str:
    """A character class of Java as RE2 spells it."""
    return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", java)


def same_look(c: str) -> str:
    seen, meant = unify.look_pairs()
    out = f"translate(regexp_replace(regexp_replace({c}, '{_class(unify.INVISIBLE)}', '', 'g'), '{_class(unify.BLANK)}', ' ', 'g'), {_text(seen)}, {_text(meant)})"
    for sign, spelled in unify.EXPANSIONS.items():
        out = f"replace({out}, {_text(sign)}, {_text(spelled)})"
    return out


def loose_key(c: str) -> str:
    accented, plain = unify.accent_pairs()
    bare = f"translate(regexp_replace({same_look(c)}, '{_class(unify.MARKS)}', '', 'g'), {_text(accented)}, {_text(plain)})"
    return rf"nullif(regexp_replace(lower({bare}), '[^\p{{L}}\p{{N}}]+', '', 'g'), '')"


def _host(c: str) -> str:
    found = rf"lower(regexp_extract(trim({same_look(c)}), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1))"
    return rf"nullif(regexp_replace({found}, '^(?:www\.)+|\.+$', '', 'g'), '')"


def _domain(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace(lower(trim({same_look(c)})), '^[a-z][a-z0-9+.\-]*://', ''), '[/?#:].*$', '')"
    return rf"nullif(regexp_replace({bare}, '^(?:www\.)+|\.+$', '', 'g'), '')"


_OWNED = f"""
names as (
  select k, min_by(source, (o, source)) as contributor from (
    select {loose_key('source')} as k, source, 0 as o from source_dim union all select '@' || {_domain('domain')}, source, coalesce(ord, 0) from domain_dim)
  where k is not null and source is not null group by k),
keyed as (
  select ordinal, batch_no, score, case when s is null or s = 'unknown' then '@' || h else s end as k, case when s <> 'unknown' then '@' || d end as dk
  from (select ordinal, batch_no, score, {loose_key('source')} as s, {_host('url')} as h, {_domain('source')} as d from leads)),
owned as (
  select ordinal, batch_no, score, coalesce(a.contributor, b.contributor) as contributor from keyed left join names a on keyed.k = a.k left join names b on keyed.dk = b.k)
"""

P1_FOUND = f"""
with {_OWNED},
sizes as (select batch_no, count(*) // 20 as most from leads group by batch_no),
ranked as (
  select *, row_number() over (partition by batch_no, contributor order by case when isnan(score) then null else score end desc nulls last, ordinal) as place
  from owned where contributor is not null)
select ordinal from ranked join sizes on ranked.batch_no is not distinct from sizes.batch_no where place > most
"""

P2_FOUND = f"""
with t as (select *, {loose_key('category')} as c, {loose_key('source_type')} as s from sample_targets),
ids as (select distinct id, c, s from (select id, {loose_key('category')} as c, {loose_key('source_type')} as s from leads) where id is not null and c is not null and s is not null),
whole as (select count(distinct id) // 5 as n from ids)
select category, source_type from (
  select t.category, t.source_type, any_value(target_bp) as bp, any_value(min_rows) as least, count(ids.id) as have from t left join ids on t.c = ids.c and t.s = ids.s group by all), whole
where have < greatest(coalesce(least, 0), (coalesce(bp, 0) * n + 9999) // 10000)
"""
