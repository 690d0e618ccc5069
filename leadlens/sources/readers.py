"""Readers for JSON documents, script-wrapped JSON, feeds, pages and shop listings, all with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.functions.text import strip_html
from leadlens.operators.windows import keep_first

FEED_ITEM = (
    "title string, link array<struct<_VALUE:string,_href:string>>, description string, summary string, content string, pubDate string, updated string, "
    "thumbnail array<struct<_url:string>>, enclosure array<struct<_url:string,_type:string>>"
)
#: Texts of prize winners by language.
NAMES = "struct<en:string,ja:string>"
AWARD = f"properName {NAMES}, generalName {NAMES}, outline struct<en:string,source:string>, businessOwner {NAMES}, awards array<struct<name:{NAMES}>>, category string"
SHOP = (
    "products array<struct<title:string,handle:string,body_html:string,tags:array<string>,variants:array<struct<price:string>>,"
    "images:array<struct<src:string,url:string>>>>"
)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of JSON arrays, or of the ``items`` of JSON objects, in all files of a path, with a dense ``ordinal``.

    Files count in the order of their paths. A missing path gives an empty table; members that are
    no objects are left out.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("ordinal", T.LongType())]))
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    body = F.when(F.startswith("value", F.lit("{")), F.get_json_object("value", "$.items")).otherwise(F.col("value"))
    members = F.from_json(body, T.ArrayType(T.StringType()))
    each = whole.select("file", F.posexplode(members).alias("place", "member")).where(F.startswith(F.trim("member"), F.lit("{")))
    sizes = each.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("place"))
    numbered = each.withColumn("nth", nth).join(starts, "file")
    return numbered.select(F.from_json("member", schema).alias("r"), (F.col("before") + F.col("nth")).cast("long").alias("ordinal")).select("r.*", "ordinal")


def raw_leads(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The rows of several folders of JSON files, those of earlier paths first, without rows that have neither title nor url; ``ordinal`` is dense."""
    parts = [json_rows(spark, p, schema).withColumn("_part", F.lit(i)) for i, p in enumerate(paths)]
    whole = reduce(lambda a, b: a.unionByName(b), parts).where("coalesce(title, '') <> '' or coalesce(url, '') <> ''")
    # places within a part count from 1; parts are few, so their sizes are summed on the driver
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("ordinal"))
    sizes = {r[0]: r[1] for r in whole.groupBy("_part").count().collect()}
    starts = F.element_at(F.array(*[F.lit(sum(sizes.get(j, 0) for j in range(i))) for i in range(len(paths))]), F.col("_part") + 1)
    return whole.withColumn("ordinal", (nth + starts).cast("long")).drop("_part")


def first_history(spark: SparkSession, paths: list[str], schema: T.StructType, field: str) -> DataFrame:
    """The first file of a chain, JSON or assigned by a script, in which ``field`` is there; an empty table if none has it."""
    for path in paths:
        if exists(spark, path):
            text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
            body = F.when(F.startswith("value", F.lit("{")), F.col("value")).otherwise(F.regexp_extract("value", r"(?s)=\s*(\{.*\})\s*;?\s*$", 1))
            found = text.select(F.from_json(body, schema).alias("r")).select("r.*").where(F.col(field).isNotNull())
            if not found.isEmpty():
                return found
    return spark.createDataFrame([], schema)


def script_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The object that a script assigns (``window.X = {...};``), one row a file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json(F.regexp_extract("value", r"(?s)=\s*(\{.*\})\s*;?\s*$", 1), schema).alias("r")).select("r.*")


def feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of RSS (``item``) or Atom (``entry``) files: title, link, description, image, published; none without title or link."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(FEED_ITEM).load(path)
    first = F.get("link", F.lit(0))
    body = F.coalesce("description", "summary", "content", F.lit(""))
    enclosed = F.filter("enclosure", lambda e: F.startswith(e["_type"], F.lit("image/")))
    shown = F.coalesce(F.get("thumbnail", F.lit(0))["_url"], F.get(enclosed, F.lit(0))["_url"], F.nullif(F.regexp_extract(body, r"<img[^>]+src=[\"']([^\"']+)", 1), F.lit("")), F.lit(""))
    shown = F.when(F.startswith(shown, F.lit("//")), F.concat(F.lit("https:"), shown)).otherwise(shown)
    out = raw.select(
        strip_html(F.col("title")).alias("title"),
        F.trim(F.coalesce(first["_VALUE"], first["_href"])).alias("link"),
        strip_html(body).alias("description"),
        F.when(shown.rlike("^https?://"), shown).otherwise("").alias("image"),
        F.coalesce("pubDate", "updated").alias("published"),
    )
    return out.where("title <> '' and link <> ''")


def short_feed(entries: DataFrame, least: int, title: int, description: int) -> DataFrame:
    """Feed entries with titles of more than ``least`` characters, title and description cut to lengths."""
    kept = entries.where(F.length("title") > least)
    return kept.withColumns({"title": F.substring("title", 1, title), "description": F.substring("description", 1, description)})


def awards(spark: SparkSession, path: str, tiers: dict[str, tuple[float, int]], other: tuple[float, int]) -> DataFrame:
    """Prize winners of JSON pages: title, reason, company, award, and score and likes by the first tier whose word an award's name has.

    Each text is in the first language there is; of one category and title the first row stays. Pages may come one a file.
    """
    rows = json_rows(spark, path, T.StructType.fromDDL(AWARD))
    first = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    title = first(F.col("properName.en"), F.col("properName.ja"), F.col("generalName.en"))
    names = F.filter(F.transform("awards", lambda a: a["name"]["en"]), lambda n: n.isNotNull())
    low = F.lower(F.array_join(names, " "))
    score, likes = F.lit(other[0]), F.lit(other[1])
    for word, (s, n) in reversed(tiers.items()):
        met = F.coalesce(F.contains(low, F.lit(word)), F.lit(False))
        score, likes = F.when(met, s).otherwise(score), F.when(met, n).otherwise(likes)
    flat = rows.select(
        "ordinal", "category", title.alias("title"), first(F.col("outline.en"), F.col("outline.source")).alias("reason"), first(F.col("businessOwner.en"), F.col("businessOwner.ja")).alias("company"),
        F.coalesce(F.array_join(names, ", "), F.lit("")).alias("award"), score.alias("score"), likes.alias("likes"),
    ).where("title <> ''")
    return keep_first(flat, ["category", "title"], [F.col("ordinal")]).drop("ordinal")


def meta(html: Column, name: str) -> Column:
    """Content of the first meta tag of a property or name, in either order of attributes; '' if there is none."""
    safe = name.replace(":", r"\:")
    a = F.regexp_extract(html, rf"(?is)<meta[^>]*(?:property|name)\s*=\s*[\"']{safe}[\"'][^>]*content\s*=\s*[\"']([^\"']*)", 1)
    b = F.regexp_extract(html, rf"(?is)<meta[^>]*content\s*=\s*[\"']([^\"']*)[\"'][^>]*(?:property|name)\s*=\s*[\"']{safe}[\"']", 1)
    return F.when(a != "", a).otherwise(b)


def pages(rows: DataFrame, html: str) -> DataFrame:
    """``rows`` with page_title, description, image and canonical read from their HTML."""
    h = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    pick = lambda *names: F.coalesce(*[F.nullif(meta(h, n), F.lit("")) for n in names], F.lit(""))
    title = F.nullif(strip_html(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return rows.withColumns({
        "page_title": F.coalesce(F.nullif(meta(h, "og:title"), F.lit("")), title, F.lit("")),
        "description": pick("og:description", "twitter:description", "description"),
        "image": pick("og:image", "twitter:image"),
        "canonical": F.regexp_extract(h, r"(?is)<link[^>]*rel\s*=\s*[\"']canonical[\"'][^>]*href\s*=\s*[\"']([^\"']*)", 1),
    })


def cards(rows: DataFrame, html: str) -> DataFrame:
    """One row per linked picture of a listing page: link, image and title (the picture's alternative text)."""
    pattern = r"(?is)<a[^>]+href=[\"'][^\"']+[\"'][^>]*>\s*<img[^>]+>"
    found = rows.select("*", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0))).alias("place", "_card"))
    part = lambda name: F.regexp_extract("_card", rf"(?is)\b{name}=[\"']([^\"']*)", 1)
    return found.withColumns({"link": part("href"), "image": part("src"), "title": strip_html(part("alt"))}).where("title <> ''").drop("_card")


def headings(rows: DataFrame, html: str) -> DataFrame:
    """One row per second- or third-level heading of a page, with its place and text."""
    found = rows.select("*", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<h[23][^>]*>(.*?)</h[23]>"), F.lit(1))).alias("place", "_h"))
    return found.withColumn("title", strip_html(F.col("_h"))).where("title <> ''").drop("_h")


def nested_values(rows: DataFrame, json: str, key: str, depth: int) -> DataFrame:
    """``value``: strings under ``key`` in a JSON text, in the object itself or up to ``depth`` levels of objects and arrays deeper."""
    level = rows.select("*", F.try_parse_json(F.col(json)).alias("_v")).where("_v is not null")
    found = []
    for _ in range(depth + 1):
        found.append(level.select(*rows.columns, F.try_variant_get("_v", f"$.{key}", "string").alias("value")).where("value is not null"))
        level.createOrReplaceTempView("_nested")
        level = rows.sparkSession.sql(f"select {', '.join(f'n.`{c}`' for c in rows.columns)}, e.value as _v from _nested n, lateral variant_explode(n._v) e")
        level = level.where("schema_of_variant(_v) like 'OBJECT%' or schema_of_variant(_v) like 'ARRAY%'")
    rows.sparkSession.catalog.dropTempView("_nested")
    return reduce(lambda a, b: a.unionByName(b), found)


def shop(rows: DataFrame, json: str) -> DataFrame:
    """Products of a shop's JSON: title, handle, description, highest price, first image."""
    parsed = rows.select("*", F.explode(F.from_json(F.col(json), SHOP)["products"]).alias("p"))
    image = F.get(F.filter(F.transform("p.images", lambda i: F.coalesce(i["src"], i["url"])), lambda u: u.rlike("^(https?:)?//")), F.lit(0))
    return parsed.select(
        F.col("p.title").alias("title"), F.col("p.handle").alias("handle"), strip_html(F.col("p.body_html")).alias("description"), F.col("p.tags").alias("tags"),
        F.array_max(F.transform("p.variants", lambda v: v["price"].try_cast("double"))).alias("price"), image.alias("image"),
    )


def json_block(text: Column, schema: T.StructType) -> Column:
    """The first ``{...}`` block of a text, parsed; null where it does not parse."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)
