"""Titles, urls and identity keys on cases worked out by hand."""

import unicodedata

from pyspark.sql import functions as F

from leadlens.functions import identity, text, times, url
from leadlens.operators import aggregates, joins, resolution


def one(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "c string").select(column(F.col("c"))).collect()]


def test_compatibility_form_is_unicode_s(spark):
    values = ["plain", "Ｍｕｇ", "é", "㎖ ½ ﬁ ™ …", "⽔杯", " x", "", None, "𝐀", "İ"]
    assert one(spark, text.nfkc, *values) == [v if v is None else unicodedata.normalize("NFKC", v) for v in values]


def test_titles(spark):
    assert one(spark, text.clean_title, "Pinterest · <b>Mug</b>", "A' Design Award - Cup", " ", None, "Pinterest") == ["Mug", "Cup", text.UNTITLED, text.UNTITLED, "Pinterest"]
    assert one(spark, text.candidate_title, "Box :: Behance", "Cup - yanko design", "", None) == ["Box", "Cup", text.UNTITLED, text.UNTITLED]
    assert one(spark, text.core_title, "The Mug | Uncrate", "Ｍｕｇ—杯", None) == ["the mug", "mug 杯", ""]


def test_urls(spark):
    shop = "HTTP://Shop.Example.com/a/B/?utm_source=x&id=7&b=&spm=1#frag"
    assert one(spark, url.canonical, shop, "https://a.example/?q=a+b%2Fc&x=~*", "", None) == ["http://shop.example.com/a/B?id=7", "https://a.example?q=a+b%2Fc&x=~%2A", "", ""]
    pages = ["https://a.example/p/1", "https://www.google.com/x/y/z/1", "ftp://a.example/p/1", "https://a.example/tag/x", "https://a.example/p?q=1", "mug"]
    assert one(spark, url.direct, *pages) == [pages[0], "", "", "", "", ""]
    assert one(spark, url.social, "https://X.example/p/1/?share_token=1&a=b", "/p/1", "ftp://x", None) == ["https://x.example/p/1?a=b", "", "", ""]


def test_identity_keys(spark):
    rows = [
        (1, "case", "Anker Nano Power Bank (10K, 45W)", None, "Anker's nano. Page evidence: Foo Bar2000"),
        (2, "case", "A case by Ox", "Ox Q5-Max Pro Pro", None), (3, None, None, None, None), (4, "case", "ＡＢＣ Stand42 holder", "", "with a kickstand"),
    ]
    table = spark.createDataFrame(rows, "ordinal int, category string, title string, product_identity string, reason string")
    found = identity.with_keys(
        table, F.coalesce("category", F.lit("none")), F.col("title"), F.col("product_identity"), F.col("reason"), "keys",
        {"case": (["abc"], {"stand": ["kickstand", "支架"]})}, {"anker-nano": ["anker", "nano"]},
    )
    assert {r.ordinal: r["keys"] for r in found.collect()} == {
        1: ["named:case:anker-nano"], 2: ["explicit:case:q5max:pro", "explicit-core:case:q5max:pro", "identity:case:q5max:pro"], 3: [], 4: ["identity:case:abc:stand42", "family:case:abc:stand"],
    }


def test_windows_of_the_day(spark):
    at = spark.sql("select timestamp '2026-08-21 11:56:30' as t union all select timestamp '2026-08-21 11:57:01' union all select timestamp '2026-08-21 14:00:00'")
    opened, left = times.clock_window(F.col("t"), [("09:00", "12:00"), ("14:00", "18:00")])
    assert sorted((str(r.t), r.o, r.m) for r in at.select("t", opened.alias("o"), left.alias("m")).collect()) == [
        ("2026-08-21 11:56:30", "09:00-12:00", 0), ("2026-08-21 11:57:01", "", 0), ("2026-08-21 14:00:00", "14:00-18:00", 237),
    ]


def test_decisions_after_a_withdrawal(spark):
    rows = [("a", "p", "like", 1), ("a", "p", "clear", 2), ("a", "p", "pass", 3), ("a", "p", "like", 4), ("a", "q", "clear", 5), ("b", "q", "like", None), ("b", "q", "clear", 9)]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "actor string, product string, action string, at int, ordinal int")
    got = aggregates.latest_decisions(table, ["actor", "product"], "at", "ordinal", "action", "clear").collect()
    assert [(r.actor, r["product"], r.action, r.since.ordinal) for r in got] == [("a", "p", "like", 2)]


def test_decisions_on_pools(spark):
    make = lambda *ids: spark.createDataFrame([(i, i) for i in ids], "id string, keep_ string")
    decided = spark.createDataFrame([("a", False), ("c", True), ("d", False)], "id string, keep boolean")
    got = joins.apply_decisions(make("a", "b"), make("b", "c", "d", "e"), decided, "id").collect()
    assert {r.id: r.state for r in got} == {"a": "rejected", "b": "kept", "c": "rescued", "d": "rejected", "e": "rejected"}


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, [f"k{i}", f"k{i + 1}"]) for i in range(30)], "id int, keys array<string>")
    assert {r.component for r in resolution.components(chain, "id", "keys").collect()} == {0}
    try:
        resolution.components(chain, "id", "keys", most_rounds=1)
        raise AssertionError
    except RuntimeError:
        pass
