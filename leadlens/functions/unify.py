"""Column functions that bring text to one consistent form, all inside the JVM.

The one-to-one tables are derived from ``unicodedata`` by rule; only the look-alike letters and
the characters that expand to several are stated as fixed values.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and signs of the same shape, written as pairs (seen, meant).
LOOKALIKES = (
    # Cyrillic
    "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ӏl ѵv үy "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԚQ ԜW ҮY ӀI ЗЗ "
    # Greek
    "οo νv ϲc ϳj αɑ ρp "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ "
    # Armenian
    "ոn սu օo հh ցg զq ՕO ՍU Տs "
    # Cherokee
    "ᎪA ᎠD ᎡR ᎢT ᎥI ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏒR ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB ᎺM "
    # Latin letters of other alphabets
    "ɡg ɑa ıi ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "
    # signs
    "‐- ‑- ꞉: ∶: ʼ' ‚, ⁄/ ∕/ ❘| ∣|"
)
# One character that stands for several of the same look.
EXPANSIONS = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "‥": "..",
    "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅺ": "XI", "Ⅻ": "XII",
    "ⅱ": "ii", "ⅲ": "iii", "ⅳ": "iv", "ⅵ": "vi", "ⅶ": "vii", "ⅷ": "viii", "ⅸ": "ix", "ⅺ": "xi", "ⅻ": "xii",
    "ĳ": "ij", "Ĳ": "IJ", "ǉ": "lj", "ǌ": "nj", "Ǉ": "LJ", "Ǌ": "NJ",
}
# Squared unit signs, spelled out where units are read.
UNIT_SIGNS = {"㎖": "ml", "㏄": "ml", "㎜": "mm", "㎝": "cm", "㎏": "kg", "㎎": "mg", "㎡": "m2", "℃": "c"}

#: Characters without a look of their own, as a Java character class.
INVISIBLE = (
    "[\\u0000-\\u0008\\u000E-\\u001F\\u007F-\\u009F\\u00AD\\u034F\\u061C\\u115F\\u1160\\u17B4\\u17B5\\u180B-\\u180F"
    "\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u206F\\u3164\\uFE00-\\uFE0F\\uFEFF\\uFFA0\\uFFF9-\\uFFFB\\x{E0000}-\\x{E0FFF}]"
)
#: Characters that show as a blank, as a Java character class.
BLANK = "[\\u0009-\\u000D\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
#: Combining marks that an accent may be written with.
MARKS = "[\\u0300-\\u034E\\u0350-\\u036F]"

_SAME_LOOK = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}


@functools.cache
def look_pairs() -> tuple[str, str]:
    """(seen, meant) for every single character that looks like another single one."""
    pairs: dict[str, str] = {}
    for cp in [*range(0xA1, 0xD800), *range(0xF900, 0xFFF0), *range(0x1D400, 0x1D800)]:
        ch = chr(cp)
        kind = unicodedata.decomposition(ch)
        if not kind:
            continue
        tag = kind.split()[0]
        if tag.startswith("<") and tag not in _SAME_LOOK:
            continue
        form = unicodedata.normalize("NFKC", ch)
        if len(form) == 1 and form != ch and not form.isspace():
            pairs[ch] = form
    for pair in LOOKALIKES.split():
        pairs[pair[0]] = pair[1]
    return "".join(pairs), "".join(pairs.values())


@functools.cache
def accent_pairs() -> tuple[str, str]:
    """(accented, plain) for every precomposed Latin letter."""
    pairs = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp) and base.isascii():
            pairs[chr(cp)] = base
    pairs.update({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D"})
    return "".join(pairs), "".join(pairs.values())


def same_look(c: Column) -> Column:
    """``c`` with one character for every set of characters of the same look.

    Width, invisible characters, the sort of blank and look-alike letters go; accents keep the
    spelling they have (composed or separate), letter case and punctuation stay. Null stays null.
    """
    seen, meant = look_pairs()
    out = F.translate(F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), BLANK, " "), seen, meant)
    for sign, spelled in EXPANSIONS.items():
        out = F.replace(out, F.lit(sign), F.lit(spelled))
    return out


def fold_accents(c: Column) -> Column:
    """``c`` without accents on Latin letters, however they are written."""
    accented, plain = accent_pairs()
    return F.translate(F.regexp_replace(c, MARKS, ""), accented, plain)


def spell_units(c: Column) -> Column:
    """Squared unit signs spelled out."""
    for sign, spelled in UNIT_SIGNS.items():
        c = F.replace(c, F.lit(sign), F.lit(spelled))
    return c


def same_look_mostly_ascii(c: Column) -> Column:
    """``same_look`` for columns of mostly plain ASCII values, which it leaves alone."""
    return F.when(c.rlike("^[ -~]*$"), c).otherwise(same_look(c))


def loose_key(c: Column) -> Column:
    """The letters and digits of ``c``, lower-cased, without accents: equal for loose spellings of one name.

    Null, empty and blank-only values, and values without letters or digits, give null. Values of
    plain ASCII and common CJK ideographs take a short way to the same key.
    """
    plain = F.regexp_replace(F.lower(c), "[^a-z0-9\u4E00-\u9FFF]+", "")
    bare = F.regexp_replace(F.lower(fold_accents(same_look(c))), "[^\\p{L}\\p{N}]+", "")
    return F.nullif(F.when(c.rlike("^[ -~\u4E00-\u9FFF]*$"), plain).otherwise(bare), F.lit(""))
