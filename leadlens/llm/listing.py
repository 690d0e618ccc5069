"""Reading a listing: the title without its dress, page identity, sizes and accessory wording."""

from __future__ import annotations

import functools
import re
import unicodedata
from urllib.parse import unquote

from leadlens.functions.unify import EXPANSIONS, LOOKALIKES, UNIT_SIGNS, accent_pairs, look_pairs

# Query parameters that say how a page was reached, not which page it is.
TRACKING = set(
    "spm scm ref ref_ referrer referer from source src share share_id fbclid gclid dclid msclkid yclid igshid mc_cid mc_eid "
    "campaign cid trk tracking si feature".split()
)
# Words that titles consist of when they only name the site.
SITE_WORDS = set(
    "home homepage index untitled page menu search sign in log login register latest finds clips pins news feed blog official site website "
    "welcome about us all posts 原创产品 设计分享 首页 主页 官网 官方网站 最新 最新发现 更新 登录 注册 搜索 菜单".split()
)
# Wording of accessories and spare parts.
ACCESSORY = re.compile(
    r"^(?:replacement|spare|accessory)\b|\baccessory only\b|\bspare (?:part|lid|cap|strap|seal)|\b(?:only|spare part|accessory)\)?$"
    r"|\b(?:lid|strap|hinge|ring|tray|cap|cover|case|sleeve|filter|seal|base|handle|stand|cord) only\b|配件|专用|替换|备用|备件|仅为"
)
_LEAD = re.compile(r"^(?:new!|new:|re-?post(?:ed)?[:!]?|updated?[:!]|\[[^\]]{1,12}\]|【[^】]{1,8}】)\s*")
_TAIL = re.compile(r"\s*(?:\((?:20\d\d|photos?|new|updated?|re-?post(?:ed)?|组图|图集|补充|更新)\)|#[^\s#]+|\[[^\]]{1,12}\]|【[^】]{1,8}】)\s*$")
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[a-z]+|[^\W\d_a-z]+")
_SPLIT = re.compile(r"\s*(?:::|[|:–—_/·]|(?<=\s)-(?=\s))\s*")
_CUT = re.compile(r"\s*(?:\.{2,}|…)\s*$")


@functools.cache
def _table() -> dict[int, str | None]:
    seen, meant = look_pairs()
    table: dict[int, str | None] = {ord(s): m for s, m in zip(seen, meant)}
    accented, plain = accent_pairs()
    bare = dict(zip(accented, plain))
    table = {c: bare.get(m, m) for c, m in table.items()}
    table |= {ord(c): p for c, p in bare.items()} | {ord(s): m for s, m in (EXPANSIONS | UNIT_SIGNS).items()}
    blanks = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table |= dict.fromkeys(blanks, " ") | dict.fromkeys([*range(0x300, 0x370), *range(0xFE00, 0xFE10), 0x115F, 0x1160, 0x3164])
    table |= {cp: None for cp in range(0x20, 0x10000) if unicodedata.category(chr(cp)) == "Cf"}
    assert LOOKALIKES
    return table


@functools.cache
def _single() -> dict[str, str]:
    """The part of the table that may be replaced a character at a time: what stands for it has no other look."""
    table = _table()
    return {chr(c): m or "" for c, m in table.items() if not any(ord(x) in table for x in m or "")}


def plain(text: str) -> str:
    """The text in one look, without accents; letter case stays."""
    if text.isascii():
        return text
    single, table = _single(), _table()
    for c in set(text):
        if ord(c) in table:
            if c not in single:
                return text.translate(table)
            text = text.replace(c, single[c])
    return text


def within_one(a: str, b: str) -> bool:
    """Whether two words are one letter or one exchange of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


@functools.lru_cache(4096)
def _site(name: str) -> tuple[str, str]:
    low = plain(name).lower()
    return low, re.sub(r"[\W_]+", "", low)


def undressed(title: str, site: str | None) -> tuple[str, bool]:
    """(lower-case title without site name, repost marks and tags; whether it was cut off)."""
    x = plain(title).lower().strip()
    if "w/ " in x:
        x = x.replace("w/ ", "with ")
    cut = False
    low, key = _site(site) if site else ("", "")
    while True:
        before = x
        if x[:1] in "nru[【":
            x = _LEAD.sub("", x)
        if x[-1:] in ")]】" or "#" in x:
            x = _TAIL.sub("", x)
        if x[-1:] in ".… " and (m := _CUT.search(x)) and m.start() > 0:
            x, cut = x[: m.start()], True
        if low:
            parts = list(_SPLIT.finditer(x))
            if parts:
                last = x[parts[-1].end() :]
                bare = re.sub(r"[\W_]+", "", last)
                if within_one(bare, key) or (cut and bare and key.startswith(bare)):
                    x = x[: parts[-1].start()]
                    continue
                first = x[: parts[0].start()]
                if re.sub(r"[\W_]+", "", first) == key:
                    x = x[parts[0].end() :]
                    continue
            if x == low:
                x = ""
            elif x.endswith(" " + low) and len(parts) == 0 and len(x) > len(low) + 8:
                x = x[: -len(low)].rstrip()
        if x == before:
            return x, cut


def tokens(title: str) -> list[str]:
    return _TOKEN.findall(title)


def is_accessory(title: str) -> bool:
    """Whether a lower-case title offers an accessory or spare part."""
    hint = "only" in title or "repl" in title or "spare" in title or "access" in title
    if not hint and not title.isascii():
        hint = "配件" in title or "专用" in title or "替换" in title or "备用" in title or "备件" in title or "仅为" in title
    return hint and ACCESSORY.search(title) is not None


@functools.lru_cache(4096)
def _site_words(site: str) -> tuple[str, ...]:
    return tuple(tokens(_site(site)[0]))


def without_site(words: list[str], site: str | None) -> list[str]:
    """The words without those of the site's name, if all of them are there in whatever order."""
    name = _site_words(site) if site else ()
    if not name or len(words) <= len(name) or any(n not in words for n in name):
        return words
    words = list(reversed(words))
    for n in name:
        words.remove(n)
    return words[::-1]


def only_site(words: list[str], title: str, site: str | None) -> bool:
    """Whether a title says no more than which site it is on."""
    if not words:
        return True
    key = _site(site)[1] if site else ""
    return all(w in SITE_WORDS or (key and w in key) for w in words)


def page_key(url: str | None, sources: dict[str, str]) -> str | None:
    """One string for all spellings of a page's url; null without a host. ``sources`` names the owner of a domain."""
    if not url:
        return None
    u = plain(url).strip()
    u = u.partition("#")[0]
    scheme, sep, rest = u.partition("//")
    if not sep:
        return None
    body, _, query = rest.partition("?")
    host, _, path = body.partition("/")
    host = host.rpartition("@")[2].partition(":")[0].lower().rstrip(".")
    while host.startswith("www."):
        host = host[4:]
    if not host:
        return None
    if "%" in path:
        path = unquote(path)
    path = re.sub(r"/+", "/", path).rstrip("/")
    path = re.sub(r"(?:^|/)(?:index\.(?:html?|php)|amp)$", "", path)
    kept = sorted(
        {p for p in query.replace(";", "&").split("&") if p and (k := p.partition("=")[0].lower()) and not k.startswith("utm_") and k not in TRACKING and p.partition("=")[2]}
    )
    return f"{sources.get(host, host)}/{path}?{'&'.join(kept)}"


# Units, as (dimension, factor to the dimension's unit). Volume and weight share one
# dimension ("amount": ml and g), as ounces may be either.
UNITS = {
    "ml": ("amount", 1), "l": ("amount", 1000), "cl": ("amount", 10), "floz": ("amount", 29.57), "oz": ("amount", 28.95), "g": ("amount", 1),
    "kg": ("amount", 1000), "毫升": ("amount", 1), "升": ("amount", 1000), "克": ("amount", 1), "千克": ("amount", 1000), "公斤": ("amount", 1000),
    "盎司": ("amount", 28.95), "mm": ("length", 1), "cm": ("length", 10), "in": ("length", 25.4), "inch": ("length", 25.4), "inches": ("length", 25.4),
    "毫米": ("length", 1), "厘米": ("length", 10), "寸": ("length", 25.4), "英寸": ("length", 25.4), "lm": ("light", 1), "lumen": ("light", 1),
    "lumens": ("light", 1), "流明": ("light", 1), "mah": ("charge", 1), "ah": ("charge", 1000), "毫安时": ("charge", 1), "毫安": ("charge", 1), "安时": ("charge", 1000),
}
_SIZE = re.compile(
    r"(\d+(?:[.,]\d+)?)[\s-]*(fl\.?\s*oz|milli?lit(?:er|re)s?|lit(?:er|re)s?|ml|cl|l|oz|kg|g|mm|cm|inches|inch|in|lumens|lumen|lm|mah|ah"
    r"|毫安时|毫安|安时|毫升|升|千克|公斤|克|盎司|毫米|厘米|英寸|寸|流明)(?![a-z])"
)


@functools.lru_cache(1 << 14)
def _measure(said: tuple[str, str]) -> tuple[str, float]:
    value, unit = said
    unit = re.sub(r"[\s.]", "", unit)
    unit = {"m": "ml"}.get(unit, "ml" if unit.startswith("mil") else "l" if unit.startswith("lit") else unit)
    kind, factor = UNITS[unit]
    return kind, float(value.replace(",", "") if re.fullmatch(r"\d+,\d{3}", value) else value.replace(",", ".")) * factor


def sizes(text: str) -> list[tuple[str, float]]:
    """(dimension, value) of every measure in a lower-case text, in order."""
    return [m for m in map(_measure, _SIZE.findall(text)) if m[1] > 0]


def unmeasured(text: str) -> str:
    """A text with a blank in place of every measure."""
    return _SIZE.sub(" ", text)
