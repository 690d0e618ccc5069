"""Problem 7: listings of different sources that describe the same product.

Method: title combination voting. The tokens of title and reason (and of the page's address) that can
name a product are combined with the listing's size and, two and two, with each other. A combination's
score comes from its frequency, its length and its average position, and every listing takes its best
one. Clusters are verified (one size within a tolerance, no accessories) and merged where pairs of
names often stand together, as a model number and a model name do, and over any number of such steps.

Tokens are words of the Latin alphabet, two of them side by side, and, of scripts without blanks, pairs
of characters. A token can name a product if it is seldom written in lower case, is used by several
sources and keeps to one category; brands and dress words fail the last, plain words the first. These
figures are counted over all listings. A word that only one source uses counts for a commoner one if
it has a letter too many or too few, or two neighbours exchanged, and category and size are the same. A listing
without a long word is told by its pairs of characters and the short words of its title: of n that can
name a product, the combinations of n and of n - 1. Nothing is collected: each step is an aggregation
or an equi-join, and pairs are only formed between listings of one product. Aggregations carry hashes
where they can, so that they need no sort.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.functions.unify import loose_key
from leadlens.llm import listing
from leadlens.session import materialise, release

#: Sizes within this factor are one size; least share of a name's rows in one category (a stray one aside); most of its uses in lower case.
TOLERANCE, ONE_CATEGORY, LOWER = 1.035, 0.65, 0.5
#: Least share of a name's rows that also have the other name, for the two to be one.
ALIAS = 0.25
#: Ratio of the steps in which sizes are compared where names are.
STEP = 1.12
#: Least pairs of characters that name a product by themselves.
SIGNS = 2
#: Letters from which a word names a product by itself; shorter ones of the title count among the pairs of characters.
LONG = 6
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*")
_TWO = re.compile(r"(?<![A-Za-z0-9-])([A-Z][A-Za-z]{1,9}) (?=([A-Z][A-Za-z]{1,9})(?![A-Za-z0-9-]))")
_MORE = re.compile(r"also sold|另有|see also|compared with|instead of", re.IGNORECASE)
_SLUG = re.compile(r"[/-]([a-z]{5,})(?=-)")
_DRESS = re.compile(r"【[^】]*】|\[[^\]]*\]")
_RUN = re.compile(r"[\u3041-\u30ff\u3400-\u9fff\uac00-\ud7a3]{2,}")


_FORMS: dict[str, str] = {}


def _form(word: str) -> str:
    """The word without hyphens and capitals."""
    if len(_FORMS) > 1 << 18:
        _FORMS.clear()
    made = _FORMS[word] = word.replace("-", "").lower()
    return made


def read(title: str | None, reason: str | None, url: str | None, words: list[str]) -> tuple[list[str], str | None, float | None, bool, list[str]]:
    """(words that may name the product, dimension, size, whether it is an accessory, pairs of characters).

    All words, one of each spelling, go to ``words``; words of the address begin with "/".
    """
    head, body = listing.plain(title or ""), listing.plain(reason or "")
    low_head = head.lower()
    measures = listing.sizes(low_head) or listing.sizes(_MORE.split(body.lower(), 1)[0])
    kind, value = measures[0] if measures else (None, None)
    text = f"{head}\n{body}"
    names = dict.fromkeys([f"{a} {b}".lower() for a, b in _TWO.findall(text)])
    titled = dict.fromkeys(_WORD.findall(head))
    signs: dict[str, None] = {}
    spelled = titled | dict.fromkeys(_WORD.findall(body))
    words += spelled
    for w in spelled:
        if w < "a":  # its initial is no small one
            if len(w) >= LONG:
                names[_FORMS.get(w) or _form(w)] = None
            elif w in titled and len(form := _FORMS.get(w) or _form(w)) > 1:
                signs[f"={form}"] = None
    for w in _SLUG.findall(url or ""):
        names[f"/{w}"] = None
    if names:
        signs.clear()
    elif not head.isascii():
        for run in _RUN.findall(listing.unmeasured(_DRESS.sub(" ", head))):
            signs |= dict.fromkeys(run[i : i + 2] for i in range(len(run) - 1))
    return list(names), kind, value, listing.is_accessory(low_head) or listing.is_accessory(body[:24].lower()), list(signs)


def _parsed(rows: DataFrame) -> DataFrame:
    """Columns row, id, owner, category and what ``read`` gives; rows without a row number count the uses of a word with a small initial and with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled: Counter[str] = Counter()
        names = ["row", "id", "owner", "category", "names", "kind", "size", "accessory", "signs", "plain", "uses", "raised"]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64()]

        def counts() -> pa.RecordBatch:
            lower: Counter[str] = Counter()
            upper: Counter[str] = Counter()
            for w, n in spelled.items():
                (upper if w < "a" else lower)[w.replace("-", "").lower()] += n
            spelled.clear()
            # words that are never small here too: another task may have them small, and the sums are over all rows
            words = list(lower.keys() | upper.keys())
            uses = [pa.array(words, pa.string())] + [pa.array([c[w] for w in words], pa.int64()) for c in (lower, upper)]
            columns = [pa.nulls(len(words), t) for t in types[:9]] + uses
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            words: list[str] = []
            found = [read(*x, words) for x in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6)))]
            spelled.update(words)
            columns = [batch.column(i) for i in range(4)] + [pa.array([f[i] for f in found], types[4 + i]) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(found), t) for t in types[9:])], names=names)
            if len(spelled) > 1 << 19:
                yield counts()
        yield counts()

    wanted = rows.select(
        F.col("row").cast("long").alias("row"), F.col("id").cast("string").alias("id"), "owner", loose_key(F.col("category")).alias("category"), "title", "reason", "url"
    )
    return wanted.mapInArrow(
        run, "row bigint, id string, owner string, category string, names array<string>, kind string, size double, accessory boolean, signs array<string>, plain string, uses bigint, raised bigint"
    )


def spellings(names: DataFrame) -> DataFrame:
    """``(name, as)``: names of one source that have a letter too many or too few, or two neighbours exchanged, against a commoner name of their category and size.

    Two such names share a form with one letter left out; of those the commonest is taken. Another letter
    in a place makes another name.
    """
    letters = F.sequence(F.lit(1), F.length("name"))
    left_out = F.transform(letters, lambda i: F.concat(F.substring("name", F.lit(1), i - 1), F.substr("name", i + 1)))
    spelled = F.array_distinct(F.transform(F.concat(F.array("name"), left_out), lambda f: F.xxhash64(f, F.col("category"))))
    forms = names.select(F.xxhash64("name").alias("_h"), F.explode(spelled).alias("form"))
    met = forms.groupBy("form").agg(F.min("_h").alias("a"), F.max("_h").alias("b"), F.count(F.lit(1)).alias("k")).where("a <> b")
    met = materialise(met, "forms")
    # mostly two names have a form; of more, and they are few, all are taken
    crowded = materialise(met.where("k > 2").select("form"), "crowded")
    several = materialise(forms.join(crowded, "form"), "several")
    more = several.select("form", F.col("_h").alias("a")).join(several.select("form", F.col("_h").alias("b")), "form").where("a < b").select("a", "b")
    pairs = materialise(met.where("k = 2").select("a", "b").union(more).distinct(), "pairs")
    pairs = pairs.union(pairs.select("b", "a"))
    full = names.select("name", "n", "shared", "bits", F.xxhash64("name").alias("_h"))
    one = pairs.join(full.where("not shared").withColumnRenamed("_h", "a"), "a").join(full.select(*[F.col(c).alias(f"_{c}") for c in ("name", "n", "shared", "bits")], F.col("_h").alias("b")), "b")
    sorted_ = lambda c: F.array_sort(F.split(c, ""))
    one = one.where("bits = 0 or _bits = 0 or (bits & _bits) <> 0").where((F.length("name") != F.length("_name")) | (sorted_("name") == sorted_("_name")))
    one = one.where(F.struct("_shared", "_n", "_name") > F.struct("shared", "n", "name"))
    found = materialise(one.groupBy("name").agg(F.max(F.struct("_shared", "_n", "_name"))["_name"].alias("as")), "spellings")
    release(met, crowded, several)
    return found


def by_signs(main: DataFrame, voted: DataFrame, generic: DataFrame) -> DataFrame:
    """``(id, owner, kind, size, name)`` of the listings without a name (not in ``voted``) that share the combination of their pairs of characters, or all but one of them, with another source."""
    rows = materialise(main.where("size(signs) > 0").select("row", "id", "owner", "category", "kind", "size", "signs"), "signed")
    each = rows.select(F.xxhash64("owner").alias("owner"), "category", F.explode("signs").alias("sign"))
    counts = each.groupBy("sign", "category").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high"))
    kept = counts.groupBy("sign").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    kept = kept.where(F.col("top") + 1 >= ONE_CATEGORY * F.col("n")).select("sign").join(generic.select(F.concat(F.lit("="), "plain").alias("sign")), "sign", "left_anti")
    bare = rows.select("row", "id", "owner", "kind", "size", F.explode("signs").alias("sign")).join(kept, "sign").join(voted.select("row"), "row", "left_anti")
    bare = bare.groupBy("row").agg(
        F.collect_set(F.xxhash64("sign")).alias("signs"), F.max(F.startswith("sign", F.lit("="))).alias("word"), *[F.first(c).alias(c) for c in ("id", "owner", "kind", "size")]
    ).where((F.size("signs") >= SIGNS) | F.col("word"))
    total = F.aggregate("signs", F.lit(0).cast("long"), lambda s, x: F.expr("0L") + s.bitwiseXOR(x))
    less = F.when(F.size("signs") > SIGNS, F.transform("signs", lambda x: x.bitwiseXOR(F.col("whole")))).otherwise(F.array().cast("array<bigint>"))
    bare = materialise(bare.withColumn("whole", total).withColumn("combination", F.explode(F.concat(F.array("whole"), less))), "signs")
    met = bare.groupBy("combination").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high")).where("low <> high")
    best = bare.join(met.select("combination", "n"), "combination").groupBy("row").agg(
        F.max(F.struct("n", "combination"))["combination"].alias("combination"), *[F.first(c).alias(c) for c in ("id", "owner", "kind", "size")]
    )
    return best.select("id", "owner", "kind", "size", F.concat(F.lit("+"), F.hex("combination")).alias("name"))


def last_of(alias: DataFrame) -> DataFrame:
    """``(name, as)`` with every chain followed to its end, in a logarithmic number of rounds; each name points to a commoner one, so there are no rings."""
    alias = materialise(alias, "alias")
    while True:
        on = alias.select(F.col("name").alias("as"), F.col("as").alias("_next"))
        if alias.join(on, "as", "left_semi").isEmpty():
            return alias
        before, alias = alias, materialise(alias.join(on, "as", "left").select("name", F.coalesce("_next", "as").alias("as")), "alias")
        release(before)


def clusters(rows: DataFrame) -> DataFrame:
    """``(id, owner, product)`` of every listing that shares its product with another.

    ``rows`` needs row, id, owner, category, title, reason and url. Listings without id or owner,
    accessories, and listings without a name that a second source uses, in a like spelling, are in no cluster. A listing
    without a size joins its name's product if the name has one size; a name of which no listing
    states a size is one product. If the name has several sizes, a listing without one could be of
    any of them and is in no cluster. Repeated rows change nothing.
    """
    parsed = materialise(_parsed(rows), "parsed")
    main = parsed.where("row is not null and id is not null and owner is not null and not accessory")
    generic = parsed.where("plain is not null").groupBy("plain").agg(F.sum("uses").alias("uses"), F.sum("raised").alias("raised"))
    # written first, so that the planner knows its size and need not shuffle the words
    generic = materialise(generic.where(F.col("uses") > LOWER * F.col("raised")).select("plain"), "generic")
    step = F.floor(F.log(F.col("size")) / F.lit(math.log(STEP))) + F.crc32(F.col("kind"))
    bit = F.when(F.col("kind").isNotNull(), F.expr("shiftleft(1L, cast(pmod(_step, 63) as int))")).otherwise(F.lit(0).cast("long"))
    words = main.withColumn("_step", step).select("row", F.xxhash64("owner").alias("owner"), "category", bit.alias("bit"), F.posexplode("names").alias("place", "name")).where("not startswith(name, '/')")
    figures = {"n": F.sum("n"), "low": F.min("low"), "high": F.max("high"), "places": F.sum("places"), "bits": F.bit_or("bits"), "alone": F.max("alone")}
    counted = words.groupBy("name", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high"), F.sum("place").alias("places"), F.bit_or("bit").alias("bits")
    )
    # words as they are written, in two where there are two, are held against the plain ones after they are counted
    part = F.split("name", " ")
    counted = counted.withColumns({"_a": part[0], "_b": F.get(part, F.lit(1)), "alone": ~F.contains("name", F.lit(" "))})
    for c in ("_a", "_b"):
        counted = counted.join(generic.withColumnRenamed("plain", c), c, "left_anti")
    # in one place by name, for both of the next two
    counted = counted.withColumn("name", F.replace("name", F.lit(" "), F.lit(""))).repartition("name")
    by_category = counted.groupBy("name", "category").agg(*[v.alias(k) for k, v in figures.items()])
    whole = {**figures, "top": F.max("n")}
    # the commonest category by its count and 40 bits of its hash, in one number
    packed = F.shiftleft(F.least("n", F.lit((1 << 22) - 1)), 40) + F.xxhash64("category").bitwiseAND((1 << 40) - 1)
    names = by_category.groupBy("name").agg(*[v.alias(k) for k, v in whole.items()], F.max(packed).bitwiseAND((1 << 40) - 1).alias("category"))
    names = names.where(F.col("top") + 1 >= ONE_CATEGORY * F.col("n"))
    names = materialise(names.withColumns({"place": F.col("places") / F.col("n"), "shared": F.col("low") < F.col("high")}), "names")
    as_written = spellings(names.where("alone and name rlike '^[a-z]{6,}$'"))
    known = names.join(as_written, "name", "left").withColumn("as", F.when(F.col("as").isNotNull(), F.col("as")).when(F.col("shared"), F.col("name")))
    score = F.log2(F.col("n") + 1) * F.length("name") / (F.col("place") + 2)
    known = materialise(known.where("as is not null").select("name", "as", "n", score.alias("score")), "known")

    # combinations of one name and the size, and of two names
    alone = ~F.col("name").rlike("[ /]")  # two words and words of an address are taken as they stand
    sized = main.select("row", F.explode("names").alias("name")).withColumns({"alone": alone, "name": F.translate("name", " /", "")})
    sized = sized.join(known.hint("shuffle_hash"), "name").where("alone or `as` = name").select("row", F.col("as").alias("name"), "n", "score")
    best = sized.groupBy("row").agg(F.max(F.struct("score", "n", "name"))["name"].alias("name"), F.collect_set("name").alias("all"))
    voted = materialise(best.join(main.select("row", "id", "owner", "kind", "size"), "row"), "votes")
    signed = by_signs(main, voted, generic)

    # names that stand for each other: the rarer one takes the place of the commoner
    both = voted.where("size(all) > 1").select("all", F.explode("all").alias("name")).select("name", F.explode("all").alias("other")).where("name <> other")
    both = both.groupBy("name", "other").agg(F.count(F.lit(1)).alias("m"))
    counts = known.where(F.col("name") == F.col("as")).select("name", "n")
    rank = lambda n, name: F.struct(F.col(n), F.col(name))
    alias = both.join(counts, "name").join(counts.select(F.col("name").alias("other"), F.col("n").alias("n_other")), "other")
    alias = alias.where(F.col("m") >= ALIAS * F.col("n")).where(rank("n_other", "other") > rank("n", "name"))
    alias = last_of(alias.groupBy("name").agg(F.max(F.struct("m", "n_other", "other"))["other"].alias("as")))
    placed = voted.join(alias, "name", "left").withColumn("name", F.coalesce("as", "name")).select("id", "owner", "kind", "size", "name")
    done, voted = voted, materialise(placed.union(signed), "voted")
    release(parsed, generic, names, known, done, alias)

    # one size within the tolerance
    measures = voted.where("kind is not null").select("name", "kind", F.round("size", 1).alias("size")).distinct()
    by_size = Window.partitionBy("name", "kind").orderBy("size")
    step = (F.col("size") > F.lag("size").over(by_size) * TOLERANCE).cast("int")
    measures = measures.withColumn("_step", F.coalesce(step, F.lit(0)))
    measures = measures.withColumn("group", F.sum("_step").over(by_size)).drop("_step")
    span = measures.groupBy("name").agg(F.min(F.struct("kind", "group")).alias("low"), F.max(F.struct("kind", "group")).alias("high"))
    placed = voted.withColumn("size", F.round("size", 1)).join(measures, ["name", "kind", "size"], "left")
    placed = placed.join(span, "name", "left").where("kind is not null or low is null or low = high")
    kind, group = F.coalesce("kind", "low.kind"), F.when(F.col("kind").isNull(), F.col("low.group")).otherwise(F.col("group"))
    product = F.concat_ws(":", "name", kind, group)
    return placed.select("id", "owner", product.alias("product")).distinct()


def pairs(found: DataFrame) -> DataFrame:
    """``(id_a, id_b)``: listings of one product by different owners, ``id_a < id_b`` as strings."""
    left = found.select("product", F.col("id").alias("id_a"), F.col("owner").alias("_a"))
    right = found.select("product", F.col("id").alias("id_b"), F.col("owner").alias("_b"))
    return left.join(right, "product").where("id_a < id_b and _a <> _b").select("id_a", "id_b").distinct()
