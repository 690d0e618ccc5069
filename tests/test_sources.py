"""Readers and writers."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.sources import readers, writers

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType())])


def test_json_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "title": "x", "more": 1}, 7, {"id": "2"}]))
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"id": "3"}]}))
    got = readers.json_rows(spark, f"{tmp_path}/*.json", SCHEMA).orderBy("ordinal").collect()
    assert [(r.id, r.title, r.ordinal) for r in got] == [("1", "x", 1), ("2", None, 2), ("3", None, 3)]
    assert readers.json_rows(spark, f"{tmp_path}/none.json", SCHEMA).count() == 0


def test_script_json(spark, tmp_path):
    (tmp_path / "data.js").write_text('window.DATA = {"id": "1",\n "title": "{x}"};\n')
    assert [tuple(r) for r in readers.script_json(spark, f"{tmp_path}/data.js", SCHEMA).collect()] == [("1", "{x}")]


def test_feeds(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        "<rss><channel><item><title>A &amp; B</title><link>https://a.example/1</link><description>&lt;p&gt;Hi &lt;img src='https://i.example/1.png'&gt;&lt;/p&gt;</description>"
        "<pubDate>today</pubDate></item><item><title>no link</title></item></channel></rss>"
    )
    (tmp_path / "a.xml").write_text('<feed><entry><title>T</title><link href="https://a.example/2"/><summary>S</summary></entry></feed>')
    got = readers.feed(spark, f"{tmp_path}/r.xml").collect()
    assert [(r.title, r.link, r.description, r.image) for r in got] == [("A & B", "https://a.example/1", "Hi", "https://i.example/1.png")]
    assert [(r.title, r.link) for r in readers.feed(spark, f"{tmp_path}/a.xml", "entry").collect()] == [("T", "https://a.example/2")]


def test_pages_cards_and_shops(spark):
    html = (
        "<html><head><title>Plain</title><script>'<title>no</title>'</script><meta property='og:title' content='First'><meta property='og:title' content='Second'>"
        "<meta content=\"About\" name='description'><link rel='canonical' href='https://a.example/x'></head><body><a href='/p/1'><img src='//i/1.png' alt='Mug &amp; cup'></a></body></html>"
    )
    rows = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    first = {r.page_id: r for r in readers.pages(rows, "html").collect()}
    assert (first[1].page_title, first[1].description, first[1].image, first[1].canonical) == ("First", "About", "", "https://a.example/x")
    assert [(r.link, r.image, r.title) for r in readers.cards(rows, "html").collect()] == [("/p/1", "//i/1.png", "Mug & cup")]
    shop = json.dumps({"products": [{"title": "T", "variants": [{"price": "3"}, {"price": "12.5"}, {"price": "?"}], "images": [{"src": "x"}, {"src": "https://i/2.png"}]}]})
    made = readers.shop(spark.createDataFrame([(shop,)], "json string"), "json").collect()
    assert [(r.title, r.price, r.image) for r in made] == [("T", 12.5, "https://i/2.png")]


def test_json_block(spark):
    rows = spark.createDataFrame([("see {\"id\": \"7\"} end",), ("none",), (None,)], "t string")
    assert [r[0] for r in rows.select(readers.json_block(F.col("t"), SCHEMA)["id"]).collect()] == ["7", None, None]


def test_merge_append_keeps_the_old_row(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), "id string, v int")
    writers.merge_append(frame(("a", 1), ("b", 2)), f"{tmp_path}/t", ["id"], [F.col("v")])
    writers.merge_append(frame(("a", 9), ("c", 3), ("c", 4)), f"{tmp_path}/t", ["id"], [F.col("v")])
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert writers.export_json(frame(("a", 1)), f"{tmp_path}/o.json") == 1
    assert "| 1 | a\\|b |" in writers.markdown_report(spark.createDataFrame([("a|b",)], "t string"), ["t"])
    writers.append_audit(frame(("run", 3)), f"{tmp_path}/audit")
    writers.append_audit(frame(("run", 4)), f"{tmp_path}/audit")
    assert spark.read.parquet(f"{tmp_path}/audit").agg(F.sum("v")).first()[0] == 7
