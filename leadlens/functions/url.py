"""Url functions over columns; a url is split with the pattern of RFC 3986, appendix B."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlens.functions.text import unescape

# Query parameters that do not name the page.
TRACKING = tuple(
    "utm_source utm_medium utm_campaign utm_term utm_content spm fbclid gclid xsec_token xsec_source share_from_user_hidden share_id share_sign timestamp".split()
)
SHARED = ("share_token", "share_sign", "xsec_token")
# Query parameters of search pages, hosts of search engines, and path segments of listings.
SEARCH_KEYS = tuple("q query keyword keywords search s wd k".split())
SEARCH_HOSTS = ("duckduckgo.com", "google.com", "bing.com", "baidu.com")
LISTING_SEGMENTS = tuple(
    "search tag tags category categories collection collections topic topics explore discover feed archive page pages market".split()
)
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_HOST = r"^(?:[^:/?#]+:)?//([^/?#]*)"
_PATH = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def host(c: Column) -> Column:
    """Lower-case authority; '' if there is none."""
    return F.lower(F.regexp_extract(c, _HOST, 1))


def parameters(c: Column) -> Column:
    """``key=value`` strings of the query that have a value."""
    pairs = F.split(F.regexp_extract(c, _QUERY, 1), "&")
    return F.filter(pairs, lambda p: p.rlike("^[^=]+=.+"))


def decoded(c: Column) -> Column:
    """A form value as it was before encoding; one that cannot be decoded stays."""
    return F.coalesce(F.try_url_decode(c), c)


def encoded(c: Column) -> Column:
    """A form value encoded, ``*`` and ``~`` as Python does it."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(c: Column) -> Column:
    """One spelling of a url: lower-case scheme and host, no trailing slashes, tracking parameters or fragment, the query encoded anew; '' for none."""
    u = F.trim(unescape(F.coalesce(c, F.lit(""))))
    scheme = F.lower(F.regexp_extract(u, _SCHEME, 1))
    pairs = F.transform(
        parameters(u), lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.substr(p, F.instr(p, "=") + 1)).alias("v"))
    )
    kept = F.filter(pairs, lambda p: ~p["k"].isin(*TRACKING) & ~p["k"].startswith("utm_"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    path = F.regexp_replace(F.regexp_extract(u, _PATH, 1), "/+$", "")
    body = F.concat(
        F.when(scheme == "", "https").otherwise(scheme),
        F.when((host(u) == "") & path.rlike("^[^/]"), ":").otherwise("://"),  # a path alone gets no authority
        host(u),
        path,
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(u == "", "").otherwise(body)


def is_listing(c: Column) -> Column:
    """Whether a canonical url is a search or listing page and no item: by query key, last segment, or first two of at most three."""
    segments = F.filter(F.split(F.lower(F.regexp_extract(c, _PATH, 1)), "/"), lambda s: s != "")
    listed = F.array(*[F.lit(s) for s in LISTING_SEGMENTS])
    keys = F.transform(parameters(c), lambda p: F.lower(F.substring_index(p, "=", 1)))
    return (
        F.arrays_overlap(keys, F.array(*[F.lit(k) for k in SEARCH_KEYS]))
        | F.coalesce(F.array_contains(listed, F.get(segments, F.size(segments) - 1)), F.lit(False))
        | (F.arrays_overlap(F.slice(segments, 1, 2), listed) & (F.size(segments) <= 3))
    )


def social(c: Column) -> Column:
    """The url of a post on the web without what was added when it was shared; '' for other schemes."""
    u = F.trim(F.coalesce(c, F.lit("")))
    pairs = F.transform(parameters(u), lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.substr(p, F.instr(p, "=") + 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~p["k"].isin(*SHARED) & ~p["k"].startswith("utm_"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    bare = F.concat(F.lower(F.regexp_extract(u, _SCHEME, 1)), F.lit("://"), host(u), F.regexp_replace(F.regexp_extract(u, _PATH, 1), "/+$", ""))
    return F.when(u.rlike("(?i)^https?:"), F.concat(bare, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))).otherwise("")


def direct(c: Column) -> Column:
    """The canonical url if it is the page of an item on the web; '' for other schemes, search engines, search and listing pages."""
    clean = canonical(c)
    engine = reduce(lambda a, b: a | b, [host(clean).endswith(h) for h in SEARCH_HOSTS])
    return F.when(clean.rlike("^https?://[^/?#]") & ~engine & ~is_listing(clean), clean).otherwise("")


def suffixes(c: Column) -> Column:
    """A host and its parents with at least two labels, longest first: the keys of a domain look-up."""
    labels = F.split(c, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def image(c: Column) -> Column:
    """An image url with a scheme; '' for others and for placeholders."""
    full = F.when(F.startswith(c, F.lit("//")), F.concat(F.lit("https:"), c)).otherwise(c)
    bad = full.rlike(r"(?i)(placeholder|spacer|blank\.gif|favicon|1x1)")
    return F.when(full.rlike("(?i)^https?://") & ~bad, full).otherwise("")


def join(base: Column, ref: Column) -> Column:
    """A reference resolved against an absolute url; dot segments stay as they are."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(bare == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(bare, "[^/]*$", ""))
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^/]+:)", 1), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(origin, ref))
        .when(ref == "", base)
        .when(ref.rlike("^[?]"), F.concat(bare, ref))
        .when(ref.rlike("^#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .otherwise(F.concat(folder, ref))
    )


def search(site: Column, text: Column) -> Column:
    """A search url of a site."""
    return F.concat(site, encoded(text))
