"""Queries over readers and writers: each writes small files to the shared folder and reads them again."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.functions import values
from leadlens.operators import joins
from leadlens.plans.registry import query
from leadlens.session import materialise, scratch, table, write_text
from leadlens.sources import readers, writers

LEAD = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("url", T.StringType())])
_LEADS = {
    "a.json": [{"id": "1", "title": "Mug"}, {"id": "2"}, "no object", {"id": "3", "url": "https://a.example/3"}],
    "b.json": {"items": [{"id": "4", "title": "Lamp", "url": ""}, {"id": "5", "title": "", "url": ""}]},
}
_RSS = """<?xml version="1.0"?><rss><channel>
<item><title>Steel &lt;b&gt;Mug&lt;/b&gt;</title><link>https://a.example/mug</link><description>&lt;img src="https://a.example/i.png"&gt; A mug</description><pubDate>Mon</pubDate></item>
<item><title>Lamp</title><link>https://a.example/lamp</link><description>Light</description><enclosure url="//a.example/e.jpg" type="image/jpeg"/></item>
<item><title>No link</title></item></channel></rss>"""
_ATOM = """<?xml version="1.0"?><feed><entry><title>Box</title><link href="https://b.example/box"/><summary>A &lt;i&gt;gift&lt;/i&gt; box</summary><updated>2026-08-01</updated></entry></feed>"""
_PAGES = [
    (1, '<html><head><title> Plain  title </title><meta property="og:title" content="A mug"><meta name="description" content="Of steel"><meta content="https://a.example/m.png" property="og:image"><link rel="canonical" href="https://a.example/mug"></head></html>'),
    (2, "<title>Only <b>this</b></title><script>var x = '<meta property=\"og:title\" content=\"no\">'</script>"),
    (3, None),
]
_CARDS = [(1, '<a href="/p/1"><img src="//a.example/1.png" alt="Steel &amp; cork"></a> <a href="/p/2"><img alt="" src="x"></a><h2>Lamp</h2><h3> Desk <i>tray</i></h3>'), (2, "")]
_SHOP = json.dumps({"products": [{"title": "Mug", "handle": "mug", "body_html": "<p>Steel</p>", "tags": ["cup"], "variants": [{"price": "12.5"}, {"price": "40"}], "images": [{"src": "data:x"}, {"src": "https://a.example/m.png"}]}, {"title": "Tray", "handle": "tray", "variants": [{"price": "n/a"}]}]})
_AWARDS = {"items": [
    {"properName": {"en": "Cup", "ja": "カップ"}, "outline": {"en": "A cup"}, "businessOwner": {"en": "Ox"}, "awards": [{"name": {"en": "Gold Award"}}], "category": "cups"},
    {"properName": {"ja": "ランプ"}, "businessOwner": {"ja": "牛"}, "awards": [], "category": "lamps"},
    {"generalName": {"en": "Tray"}, "awards": [{"name": {"en": "Best 100"}}], "category": "cups"},
    {"properName": {"en": "Cup"}, "category": "cups"},
]}


def _file(spark: SparkSession, files: dict[str, str]) -> str:
    folder = scratch(spark, "files")
    for name, text in files.items():
        write_text(spark, f"{folder}/{name}", text)
    return folder


def _rows(*rows: tuple) -> str:
    spell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "values " + ", ".join("(" + ", ".join(map(spell, r)) + ")" for r in rows)


def sample(name: str, columns: str, *rows: tuple) -> Callable:
    """Register a query whose rows are known."""
    return query(name, f"select * from ({_rows(*rows)}) t({columns})")


@sample("read_json", "id, title, url, ordinal", ("1", "Mug", None, 1), ("2", None, None, 2), ("3", None, "https://a.example/3", 3), ("4", "Lamp", "", 4), ("5", "", "", 5))
def read_json(spark: SparkSession, d: str) -> DataFrame:
    """Objects of two JSON files, in order."""
    return readers.json_rows(spark, _file(spark, {n: json.dumps(v) for n, v in _LEADS.items()}), LEAD).withColumn("ordinal", F.col("ordinal").cast("int"))


@sample("read_raw_leads", "id, title, ordinal", ("0", "Old", 1), ("1", "Mug", 2), ("3", None, 3), ("4", "Lamp", 4))
def read_raw_leads(spark: SparkSession, d: str) -> DataFrame:
    """The legacy pool before the raw files, without rows that have neither title nor url."""
    old = _file(spark, {"pool.json": json.dumps([{"id": "0", "title": "Old"}])})
    raw = _file(spark, {n: json.dumps(v) for n, v in _LEADS.items()})
    return readers.raw_leads(spark, [old, raw], LEAD).select("id", "title", F.col("ordinal").cast("int").alias("ordinal"))


@sample("read_missing", "n", (0,))
def read_missing(spark: SparkSession, d: str) -> DataFrame:
    """A path that is not there is an empty table."""
    return readers.json_rows(spark, scratch(spark, "nowhere"), LEAD).agg(F.count(F.lit(1)).cast("int").alias("n"))


@sample("read_history", "day, n", ("2026-08-02", 2))
def read_history(spark: SparkSession, d: str) -> DataFrame:
    """The first file of a chain that has daily groups."""
    groups = {"daily_groups": [{"date": "2026-08-02", "items": [1, 2]}]}
    folder = _file(spark, {"a.json": "{}", "b.js": f"window.DATA = {json.dumps(groups)};", "c.json": json.dumps({"daily_groups": [{"date": "x", "items": []}]})})
    schema = T.StructType([T.StructField("daily_groups", T.ArrayType(T.StructType([T.StructField("date", T.StringType()), T.StructField("items", T.ArrayType(T.IntegerType()))])))])
    found = readers.first_history(spark, [f"{folder}/none.json", f"{folder}/a.json", f"{folder}/b.js", f"{folder}/c.json"], schema, "daily_groups")
    return found.select(F.explode("daily_groups").alias("g")).select(F.col("g.date").alias("day"), F.size("g.items").alias("n"))


@sample("read_feed", "title, link, description, image", ("Steel Mug", "https://a.example/mug", "A mug", "https://a.example/i.png"), ("Lamp", "https://a.example/lamp", "Light", "https://a.example/e.jpg"))
def read_feed(spark: SparkSession, d: str) -> DataFrame:
    return readers.feed(spark, _file(spark, {"feed.xml": _RSS})).select("title", "link", "description", "image")


@sample("read_short_feed", "title, description", ("Steel M", "A mu"))
def read_short_feed(spark: SparkSession, d: str) -> DataFrame:
    """Entries with titles of more than five letters, cut to lengths."""
    return readers.short_feed(readers.feed(spark, _file(spark, {"feed.xml": _RSS})), 5, 7, 4).select("title", "description")


@sample("read_atom", "title, link, description, published", ("Box", "https://b.example/box", "A gift box", "2026-08-01"))
def read_atom(spark: SparkSession, d: str) -> DataFrame:
    return readers.feed(spark, _file(spark, {"feed.xml": _ATOM}), "entry").select("title", "link", "description", "published")


@sample("read_awards", "category, title, company, award, score, likes", ("cups", "Cup", "Ox", "Gold Award", 9.2, 2000), ("lamps", "ランプ", "牛", "", 8.5, 800), ("cups", "Tray", "", "Best 100", 8.5, 800))
def read_awards(spark: SparkSession, d: str) -> DataFrame:
    """Prize winners: names in the first language there is, score and likes by prize, one row a category and title."""
    found = readers.awards(spark, _file(spark, {"page1.json": json.dumps(_AWARDS)}), {"gold": (9.2, 2000)}, (8.5, 800))
    return found.select("category", "title", "company", "award", F.col("score").cast("decimal(2,1)").alias("score"), "likes")


@sample("read_pages", "page_id, page_title, description, image, canonical", (1, "A mug", "Of steel", "https://a.example/m.png", "https://a.example/mug"), (2, "Only this", "", "", ""), (3, "", "", "", ""))
def read_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(_PAGES, "page_id int, html string")
    return readers.pages(rows, "html").select("page_id", "page_title", "description", "image", F.coalesce("canonical", F.lit("")).alias("canonical"))


@sample("read_cards", "link, image, title", ("/p/1", "//a.example/1.png", "Steel & cork"))
def read_cards(spark: SparkSession, d: str) -> DataFrame:
    return readers.cards(spark.createDataFrame(_CARDS, "page_id int, html string"), "html").select("link", "image", "title")


@sample("read_headings", "page_id, place, title", (1, 0, "Lamp"), (1, 1, "Desk tray"))
def read_headings(spark: SparkSession, d: str) -> DataFrame:
    return readers.headings(spark.createDataFrame(_CARDS, "page_id int, html string"), "html").select("page_id", "place", "title")


@sample("read_nested_titles", "title", ("Cup",), ("Mug",))
def read_nested_titles(spark: SparkSession, d: str) -> DataFrame:
    """Values of a key in JSON, up to three levels deep."""
    text = json.dumps({"display_title": "Cup", "list": [{"note": {"display_title": "Mug", "x": {"y": {"display_title": "too deep"}}}}]})
    return readers.nested_values(spark.createDataFrame([(text,), ("no json",)], "json string"), "json", "display_title", 3).select(F.col("value").alias("title"))


@sample("read_shop", "title, price, image, tag", ("Mug", 40.0, "https://a.example/m.png", ">35"), ("Tray", None, None, "price_unknown"))
def read_shop(spark: SparkSession, d: str) -> DataFrame:
    found = readers.shop(spark.createDataFrame([(_SHOP,)], "json string"), "json")
    return found.select("title", F.col("price").cast("decimal(3,1)").alias("price"), "image", F.when(F.col("price").isNull(), "price_unknown").when(F.col("price") > 35, ">35").otherwise("").alias("tag"))


@query("merge_append", "select ordinal, id from (select *, row_number() over (partition by coalesce(nullif(id, ''), nullif(url, ''), nullif(title, ''), '') order by batch_no % 2, ordinal) as n from leads where batch_no is not null) where n = 1")
def merge_append(spark: SparkSession, d: str) -> DataFrame:
    """Odd batches merged into the file of the even ones; the row there is stays, by id, else url, else title."""
    key = F.coalesce(values.first_nonempty(F.col("id"), F.col("url"), F.col("title")), F.lit(""))
    rows = table(spark, d, "leads").where("batch_no is not null").select("ordinal", "id", key.alias("key"), F.expr("batch_no % 2").alias("odd"))
    path = scratch(spark, "daily")
    for odd in (0, 1):
        writers.merge_append(rows.where(F.col("odd") == odd).drop("odd"), path, ["key"], [F.col("ordinal")])
    return spark.read.parquet(path).select("ordinal", "id")


@query("merge_new_rows", "with f as (select ordinal, url, row_number() over (partition by url order by ordinal) as n from leads where url <> '' and batch_no > 2) select ordinal from f where n = 1 and url not in (select url from leads where url <> '' and batch_no <= 2)")
def merge_new_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose url was not seen before; their urls are seen from then on."""
    rows = table(spark, d, "leads").where("url <> ''").select("ordinal", "url", "batch_no")
    state = scratch(spark, "seen")
    rows.where("batch_no <= 2").select("url").distinct().write.parquet(state)
    return writers.append_new(rows.where("batch_no > 2"), state, "url", [F.col("ordinal")]).select("ordinal")


@query("audit_totals", "select cast(sum(n) as bigint) as total, count(*) as runs from (select batch_no, count(*) as n from leads where batch_no is not null group by 1)")
def audit_totals(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows appended run by run; the total is summed when the audit is read."""
    runs = table(spark, d, "leads").where("batch_no is not null").groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"))
    path = scratch(spark, "audit")
    writers.append_audit(runs.where("batch_no % 2 = 0"), path)
    writers.append_audit(runs.where("batch_no % 2 = 1"), path)
    return spark.read.parquet(path).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("runs"))


@query("bundle", "select (select count(*) from records) as items, (select count(*) from records where first_seen <> 'unknown') as daily, (select count(distinct category) from records) as categories")
def bundle(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a published set, written side by side and read again."""
    rows = table(spark, d, "records")
    path = scratch(spark, "bundle")
    writers.write_bundle({"items": rows.select("ordinal", "id", "title"), "daily": rows.where("first_seen <> 'unknown'").select("ordinal", "first_seen"), "categories": rows.select("category").where("category is not null").distinct()}, path)
    count = lambda name: spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias(name))
    return count("items").crossJoin(count("daily")).crossJoin(count("categories"))  # one row each


@query("weekly_report", "select place, '| ' || place || ' | ' || replace(coalesce(title, ''), '|', '\\|') || ' | ' || coalesce(cast(score as varchar), '') || ' |' as line from (select title, score, row_number() over (order by score desc nulls last, ordinal) as place from records) where place <= 100")
def weekly_report(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a report over a hundred records."""
    first = table(spark, d, "records").orderBy(F.desc_nulls_last("score"), F.asc("ordinal")).limit(100)
    lines = writers.markdown_report(first.orderBy(F.desc_nulls_last("score"), F.asc("ordinal")), ["title", "score"], 100).splitlines()[2:]
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines, 1)], "place long, line string")


@query("upsert_pool", "select id, case when max(age) = 1 then 'new' else 'old' end as state from (select id, 1 as age from records where is_backfill and id <> '' union all select id, 0 from records where not is_backfill and id <> '') group by id")
def upsert_pool(spark: SparkSession, d: str) -> DataFrame:
    """A pool written, read and upserted by id: the new row of an id replaces the old one."""
    rows = table(spark, d, "records").where("id <> ''").select("id", "is_backfill")
    old = materialise(rows.where("not is_backfill").select("id", F.lit("old").alias("state")).distinct(), "pool")
    return joins.upsert(old, rows.where("is_backfill").select("id", F.lit("new").alias("state")).distinct(), "id")


