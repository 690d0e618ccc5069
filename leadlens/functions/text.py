"""Text functions over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Named character references that are spelled out, in order.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
# Substrings that say nothing about a product, removed in this order.
NOISE = tuple("爆款 同款 推荐 新品 设计 创意 2024 2025 2026 best new design product review award winner official site 官网 获奖 案例".split())
# Words left out of fingerprints.
WEAK = tuple(
    "a an and the for with from official site design product award winner project case new 创意 设计 产品 新品 官网 获奖 案例 灵感".split()
)
# Words left out of title comparison.
TITLE_NOISE = tuple(
    "red dot good if yanko dieline uncrate core77 designboom behance adobe inc pinterest facebook susifacebook search zcool 站酷 design award "
    "project the a an for of and with from this to in by home".split()
)
# Site names that may stand before a title, and what a title that is missing is called.
SITE_PREFIXES = (
    "pinterest", "behance", "instagram", "dezeen", "design milk", "yanko design", "core77", "designboom", "trendhunter", "the dieline",
    "packaging of the world", "pentawards", "小红书", "抖音", "red dot", "good design award", "if设计奖", "dia 中国设计智造大奖", "a' design award",
    "站酷", "普象网", "设计癖", "数英",
)
UNTITLED = "未命名产品"
# Names of sites inside titles, and how sites end their titles.
CORE_NOISE = (
    "yanko design", "dieline", "uncrate", "core77", "designboom", "design milk", "behance", "adobe inc", "pinterest", "facebook", "susi", "if design",
    "good design award",
)
SITE_SUFFIXES = (" :: Behance", " - DIELINE", " | Uncrate", " | Grommet")
SITE_TAILS = ("Yanko Design", "Core77 Design Awards")
_SPACE = r"[\s\p{Z}]+"


def nfkc(c: Column) -> Column:
    """Unicode's compatibility form, by the JVM's own library; null stays null.

    Spark takes what it calls by name as not deterministic, so put it into a column before a lambda uses it.
    """
    form = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).when(c.isNotNull(), form)


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def unescape(c: Column) -> Column:
    """The commonest character references spelled out."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def strip_html(c: Column) -> Column:
    """Text without tags and references, white space squeezed; null gives ''."""
    return squeeze(unescape(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")))


def clean_title(c: Column, prefixes: tuple[str, ...] = SITE_PREFIXES, default: str = UNTITLED) -> Column:
    """Title without markup and without a leading site name followed by a separator."""
    out = strip_html(c)
    if prefixes:
        names = "|".join("".join("\\" + ch if ch.isascii() and not ch.isalnum() and ch != " " else ch for ch in p) for p in prefixes)
        out = squeeze(F.regexp_replace(out, rf"(?i)^(?:{names})[\s\p{{Z}}]*[·:\-|][\s\p{{Z}}]*", ""))
    return F.when(out == "", default).otherwise(out) if default else out


def normalize(c: Column) -> Column:
    """Clean lower-case title in compatibility form, without urls, noise substrings, punctuation and extra blanks."""
    low = F.regexp_replace(nfkc(F.lower(clean_title(c))), r"https?://\S+", " ")
    low = reduce(lambda x, w: F.replace(x, F.lit(w), F.lit(" ")), NOISE, low)
    return squeeze(F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " "))


def content_tokens(c: Column) -> Column:
    """Latin words and runs of two or more Chinese characters of normalised text, weak ones left out."""
    found = F.regexp_extract_all(c, F.lit(r"([a-z0-9]+|[一-鿿]{2,})"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*WEAK))


def _plain_words(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"[^a-z0-9一-鿿]+", " "))


def core_title(c: Column) -> Column:
    """Lower-case words of a title in compatibility form: Latin letters, digits and Chinese characters, without the names of sites."""
    low = F.lower(nfkc(F.coalesce(c, F.lit(""))))
    return _plain_words(F.regexp_replace(low, rf"(?U)\b(?:{'|'.join(CORE_NOISE)})\b", " "))


def candidate_title(c: Column) -> Column:
    """A title without the site's name behind it, as a few sites write it; ``UNTITLED`` where nothing is left."""
    out = F.trim(F.coalesce(c, F.lit("")))
    for marker in SITE_SUFFIXES:
        out = F.trim(F.substring_index(out, marker, 1))
    for tail in SITE_TAILS:
        out = F.regexp_replace(out, rf"(?i)\s+-\s+{tail}$", "")
    return F.when(out == "", UNTITLED).otherwise(out)


def title_tokens(c: Column) -> Column:
    """Words of a title without noise, with plural and -ing endings taken off."""
    words = F.split(_plain_words(F.lower(nfkc(F.coalesce(c, F.lit(""))))), " ")
    stem = lambda t: (
        F.when(t.endswith("ing") & (F.length(t) > 5), F.substring(t, F.lit(1), F.length(t) - 3))
        .when(t.endswith("ies") & (F.length(t) > 5), F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y")))
        .when(t.endswith("s") & (F.length(t) > 4), F.substring(t, F.lit(1), F.length(t) - 1))
        .otherwise(t)
    )
    keep = lambda t: (t != "") & ~t.isin(*TITLE_NOISE)
    return F.filter(F.transform(F.filter(words, keep), stem), keep)


def compat_key(c: Column) -> Column:
    """A row key as the data's origin spells it: characters outside a-z and 0 to backslash go, 120 at most."""
    return F.substring(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-\x5c]+", ""), 1, 120)


def row_keys(identifier: Column, url: Column, title: Column) -> Column:
    """All keys of a row that are not empty: its id and the keys of url and title, whose scheme does not count."""
    bare = lambda c: compat_key(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "https?://", ""))
    return F.filter(F.array(F.coalesce(identifier, F.lit("")), bare(url), bare(title)), lambda k: k != "")


def truncate(c: Column, n: int) -> Column:
    """At most ``n`` characters, the last an ellipsis if something was cut."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def stable_hash(c: Column, length: int = 12) -> Column:
    """The first hex digits of the SHA-1."""
    return F.substring(F.sha1(c), 1, length)


def joined(*columns: Column) -> Column:
    """Values with a blank between them, null as ''."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])


def with_fingerprints(rows: DataFrame, category: Column, title: Column, reason: Column, creator: Column, url: Column) -> DataFrame:
    """``rows`` with ``fingerprint`` and ``product_key``: category and a hash of content tokens, the first eight.

    The fingerprint takes title and creator; under two tokens the reason counts too; without any the normalised title, then the
    url, then the title as it is. The product key takes the title, and the title's own hash where that has no token.
    """
    own = rows.columns
    staged = rows.withColumns({"_fc": category, "_ft": normalize(title), "_fn": normalize(joined(title, creator))})
    staged = staged.withColumns({"_named": content_tokens(F.col("_fn")), "_titled": content_tokens(F.col("_ft"))})
    first = lambda tokens: F.array_join(F.slice(tokens, 1, 8), "")
    staged = staged.withColumn("_more", F.when(F.size("_named") < 2, normalize(joined(title, reason, creator))))
    compact = F.when(F.size("_named") < 2, first(content_tokens(F.col("_more")))).otherwise(first(F.col("_named")))
    last = F.coalesce(F.nullif(url, F.lit("")), title, F.lit(""))
    compact = F.coalesce(F.nullif(compact, F.lit("")), F.nullif(F.col("_ft"), F.lit("")), last)
    by_title = F.coalesce(F.nullif(first(F.col("_titled")), F.lit("")), stable_hash(F.coalesce(title, F.lit(""))))
    made = {"fingerprint": F.concat("_fc", F.lit(":"), stable_hash(compact, 16)), "product_key": F.concat("_fc", F.lit(":"), stable_hash(by_title, 16))}
    return staged.withColumns(made).select(*[c for c in own if c not in made], *made)


def like_value(c: Column) -> Column:
    """The first number of a text, with its unit (万 and w: ten thousand, k: thousand) if it has one; 0 if there is none."""
    pattern = r"(\d+(?:\.\d+)?)\s*(万|w|k)?"
    number, unit = F.regexp_extract(F.lower(c), pattern, 1).try_cast("double"), F.regexp_extract(F.lower(c), pattern, 2)
    factor = F.when(unit.isin("万", "w"), 10_000).when(unit == "k", 1000).otherwise(1)
    return F.coalesce(number * factor, F.lit(0.0))


def like_count(c: Column) -> Column:
    """A count such as ``1.2万``, ``3k`` or ``980`` as a whole number."""
    return like_value(c).cast("bigint")
