"""Problem 4: check new rows for repeats against everything accepted earlier.

The index is two tables in the shared folder, bucketed by key: exact keys (page, title) and parts of
titles (bands, beginnings). The keys of a new batch are shuffled to the buckets once and appended there
as a step of their own, those that the index has not yet; a row that only repeats adds nothing. The
step is then joined with the earlier ones bucket by bucket: the history is never shuffled, and only
its rows that share a key with the step leave the scan. The index is found again by its path
(``layout``), so it survives the session; a batch that failed half-way may be given again, as its step
is written anew.

A title's signature is the multiset of its words, and its bands are that signature with one word left
out: two titles that differ in one word share a band. (Bands of minwise hashes over so few words
either miss such pairs or put all titles of one wording into a bucket; README has the figures.) Titles
that share a band are repeats if the words left out, which the band stores, are one letter or one
exchange of neighbours apart; this is verified by a further key, the word with one letter left out.
A title that was cut off is compared with the beginnings of the others.

Every check takes the smallest id of a key, so no group is collected and no pairs are formed; copies
of one title enter the bands once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadlens.llm import listing
from leadlens.session import drop_path, exists, let_go, make_dir, materialise, read_text, release, scratch, write_text

#: Least words of a title, without the one left out, for a band; and words that a cut-off title may lack.
BAND_WORDS, CUT_WORDS = 2, 4
#: Of a backlog, so many times the history's rows are checked at once.
GROWTH = 8
_MASK = (1 << 64) - 1
#: Bits of a word's hash in the sum of a title's words, so that no title overflows it.
_SUMMED = (1 << 46) - 1
#: Tables of the index and the columns that make their folders; ``kind`` of a part is one of those below, ``word`` the word left out or the next one.
TABLES = {"exact": "key bigint, id bigint", "parts": "key bigint, id bigint, word string"}
FOLDERS = {"exact": ("step",), "parts": ("step", "kind")}
BAND, BEGINNING, CUT_OFF = 0, 1, 2
#: Least words of a title, without the one left out, for a band; and words that a cut-off title may lack.
BAND_WORDS, CUT_WORDS = 2, 4
#: Of a backlog, so many times the history's rows are checked at once.
GROWTH = 8
_MASK = (1 << 64) - 1
#: Bits of a word's hash in the sum of a title's words, so that no title overflows it.
_SUMMED = (1 << 46) - 1
#: Tables of the index and the columns that make their folders; ``kind`` of a part is one of those below, ``word`` the word left out or the next one.
TABLES = {"exact": "key bigint, id bigint", "parts": "key bigint, id bigint, word string"}
FOLDERS = {"exact": ("step",), "parts": ("step", "kind")}
BAND, BEGINNING, CUT_OFF = 0, 1, 2
#: Titles of a batch that a task remembers, so as to give their bands once.
REMEMBERED = 1 << 18


def _h(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _signed(n: int) -> int:
    n &= _MASK
    return n - (1 << 64) if n >> 63 else n


class Keys:
    """Keys of one row, by page and by title."""

    def __init__(self, domains: dict[str, str]):
        self.domains = domains
        self.words: dict[str, int] = {}

    def _word(self, w: str) -> int:
        if w not in self.words:
            if len(self.words) > 1 << 18:
                self.words.clear()
            self.words[w] = _h("w" + w)
        return self.words[w]

    def of(self, title: str | None, url: str | None, owner: str | None) -> tuple[list[int], int | None, list[str] | None, int, bool, bool]:
        """(exact keys, key of the title in its order, its words, hash of the owner, whether it is cut off, whether it offers an accessory).

        The title's key is one of the exact keys; it and the words are null where a title is too short to be compared but exactly."""
        exact: list[int] = []
        page = listing.page_key(url, self.domains)
        if page:
            exact.append(_signed(_h("p" + page)))
        if not title or not owner:
            return exact, None, None, 0, False, False
        bare, cut = listing.undressed(title, owner)
        words = listing.without_site(listing.tokens(bare), owner)
        if listing.only_site(words, bare, owner):
            return exact, None, None, 0, False, False
        base, known = self._word("\0" + owner), self.words
        hashes = [known[w] if w in known else self._word(w) for w in words]
        whole = base + sum(hashes)
        exact.append(_signed(whole * 2 + 1 if cut else whole))
        if len(words) <= BAND_WORDS + cut:
            return exact, None, None, 0, False, False
        extra = listing.is_accessory(bare)
        running = base + extra
        for h in hashes:
            running = (running * 0x100000001B3 + h) & _MASK
        key = _signed(running ^ cut ^ 0x9E3779B97F4A7C15)
        exact.append(key)
        return exact, key, words, base & _SUMMED, cut, extra


def keyed(rows: DataFrame, identifier: str, title: str, url: str, owner: str, domains: dict[str, str], batch: str | None = None) -> DataFrame:
    """``(id, batch, exact, title, words, owner, cut, extra)`` of every row, as ``Keys.of`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(domains)
        for part in batches:
            found = list(zip(*[keys.of(*x) for x in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)))])) or [()] * 6
            types = (pa.list_(pa.int64()), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.bool_())
            columns = [pa.array(c, t) for c, t in zip(found, types)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["id", "batch", "exact", "title", "words", "owner", "cut", "extra"])

    number = F.col(batch).cast("long") if batch else F.lit(None).cast("long")
    wanted = rows.select(F.col(identifier).cast("long").alias("id"), number.alias("batch"), title, url, owner)
    return wanted.mapInArrow(run, "id bigint, batch bigint, exact array<bigint>, title bigint, words array<string>, owner bigint, cut boolean, extra boolean")


def parts_of(titles: DataFrame) -> DataFrame:
    """``(id, key, kind, word)`` of titles with id, words, owner, cut and extra.

    A band is the sum of all words but one, with the word left out; words that begin with a digit are
    never left out, as another size is another post. A beginning goes up to some words before the
    end, with the next word; a title cut off before "lid only" names the whole product, so accessories
    begin otherwise.
    """
    count, word = F.size("words"), F.col("words")
    summed = titles.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w).bitwiseAND(F.lit(_SUMMED))))
    summed = summed.withColumn("whole", F.aggregate("hashes", F.col("owner"), lambda a, h: a + h))
    part = lambda key, kind, w: F.struct(key.alias("key"), kind.cast("int").alias("kind"), w.alias("word"))
    left_out = F.array_distinct(F.zip_with("words", "hashes", lambda w, h: part(F.col("whole") - h, F.lit(BAND), w)))
    bands = F.when(F.col("cut"), F.array().cast("array<struct<key:bigint,kind:int,word:string>>")).otherwise(F.filter(left_out, lambda p: ~p["word"].rlike("^[0-9]")))
    first = F.greatest(F.lit(BAND_WORDS + 1), count - F.when(F.col("cut"), 1).otherwise(CUT_WORDS))
    last = F.when(F.col("cut"), count - 1).otherwise(count)
    begun = F.transform(
        F.sequence(first, last),
        lambda m: part(F.xxhash64("owner", "extra", F.slice(word, F.lit(1), m)), F.when(F.col("cut"), CUT_OFF).otherwise(BEGINNING), F.coalesce(F.get(word, m), F.lit(""))),
    )
    return summed.select("id", F.inline(F.concat(bands, begun)))


def _variants(word: Column) -> Column:
    """The word and all it leaves with one letter left out."""
    return F.array_distinct(
        F.concat(
            F.array(word),
            F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substr(word, i + 1))),
        )
    )


class History:
    """An index of accepted rows that grows batch by batch and can be opened again by its ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """``buckets`` counts for a new index only: one per core of the cluster or more; by default the session's shuffle partitions."""
        self.spark, self.path = spark, path or scratch(spark, "history")
        layout = f"{self.path}/layout"
        if exists(spark, layout):
            self.state = json.loads(read_text(spark, layout))
        else:
            self.state = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "version": 0, "step": 0}
            self._commit()
        self._attach()

    def _commit(self, **changed: int) -> None:
        self.state |= changed
        write_text(self.spark, f"{self.path}/layout", json.dumps(self.state))

    def _attach(self) -> None:
        tag = uuid.uuid4().hex
        self.names = {t: f"history_{t}_{tag}" for t in TABLES}
        for t, schema in TABLES.items():
            where = f"{self.path}/v{self.state['version']}/{t}"
            make_dir(self.spark, where)
            folders, kept = FOLDERS[t], f"clustered by (key) into {self.state['buckets']} buckets"
            columns = ", ".join([schema, *(f"{c} int" for c in folders)])
            self.spark.sql(f"create table {self.names[t]} ({columns}) using parquet partitioned by ({', '.join(folders)}) {kept} location '{where}'")
            self.spark.sql(f"alter table {self.names[t]} recover partitions")

    def close(self) -> None:
        """Forget the tables' names; the index stays."""
        for name in self.names.values():
            self.spark.sql(f"drop table if exists {name}")

    def drop(self) -> None:
        self.close()
        drop_path(self.spark, self.path)

    def table(self, name: str) -> DataFrame:
        """An index table as far as it is committed."""
        return self.spark.table(self.names[name]).where(F.col("step") < self.state["step"])

    def _write(self, name: str, rows: DataFrame, step: int) -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        drop_path(self.spark, f"{self.path}/v{self.state['version']}/{name}/step={step}")  # of a call that broke off
        rows.withColumn("step", F.lit(step)).select(*columns, *FOLDERS[name]).write.insertInto(self.names[name])

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.state["buckets"], "key")

    def accept(self, rows: DataFrame) -> DataFrame:
        """``(id)`` of the rows that repeat a row accepted earlier or one of smaller id among themselves.

        ``rows`` comes from ``keyed``; it may hold one batch or several and is read three times. Null
        and empty titles and urls give no keys; an empty batch gives an empty result.
        """
        step = self.state["step"]
        exact = rows.select("id", F.explode("exact").alias("key"))
        # what the index has is left out, but for keys of the very row, so that a batch may be given again
        older = self.table("exact").select(F.col("key").alias("_key"), F.col("id").alias("_id")).hint("shuffle_hash")
        first = self._bucketed(exact.groupBy("key").agg(F.min("id").alias("id"))).join(older, F.expr("key = _key and _id < id"), "left_anti")
        self._write("exact", first, step)
        added = self.spark.table(self.names["exact"]).where(F.col("step") == step).select(F.col("key").alias("title"), "id")
        fresh = rows.where("title is not null").select("title", "id", "words", "owner", "cut", "extra").repartition(self.state["buckets"], "title")
        self._write("parts", self._bucketed(parts_of(fresh.join(added.hint("shuffle_hash"), ["title", "id"], "left_semi"))), step)

        known = self.spark.table(self.names["exact"]).where(F.col("step") <= step).select("key", F.col("id").alias("least"))
        same = self._bucketed(exact).join(known.hint("shuffle_hash"), "key").where("id > least").select("id")
        # nothing is shuffled in these steps, as the buckets hold whole keys; few rows of the history share a key with the step
        new = self.spark.table(self.names["parts"]).where(F.col("step") == step)
        met = materialise(self.table("parts").join(new.select("key").hint("shuffle_hash"), "key", "left_semi"), "met")
        every = new.unionByName(met)
        bands, begun = every.where(F.col("kind") == BAND), every.where(F.col("kind") == BEGINNING)
        spread = bands.groupBy("key").agg(F.min(F.xxhash64("word")).alias("a"), F.max(F.xxhash64("word")).alias("b")).where("a <> b").select("key")
        spelled = bands.join(spread, "key").select("key", "id", "step", F.explode(_variants(F.col("word"))).alias("variant"))
        # words of one band that share a variant are few: they differ in one letter
        least = F.min("id").over(Window.partitionBy("key", "variant"))
        near = spelled.withColumn("least", least).where("id > least").where(F.col("step") == step).select("id")
        cut = every.where(F.col("kind") == CUT_OFF).groupBy("key", F.col("word").alias("part")).agg(F.min("id").alias("cut_id"), F.max("step").alias("cut_step"))
        pairs = begun.join(cut, "key").where("startswith(word, part)").where(f"id > cut_id and step = {step} or cut_id > id and cut_step = {step}")
        later = pairs.select(F.greatest("id", "cut_id"))
        found = materialise(same.union(near).union(later).distinct(), "repeats")
        release(met)
        self._commit(step=step + 1)
        return found

    def compact(self) -> None:
        """Write every table anew as one step, a file a bucket; the old files go when the new ones are named in ``layout``."""
        old, version = self.names, self.state["version"]
        whole = {t: self.table(t).drop("step") for t in TABLES}
        self.state["version"] += 1
        drop_path(self.spark, f"{self.path}/v{version + 1}")
        self._attach()
        for t, rows in whole.items():
            self._write(t, self._bucketed(rows).distinct(), 0)
        self._commit(step=1)
        for name in old.values():
            self.spark.sql(f"drop table if exists {name}")
        drop_path(self.spark, f"{self.path}/v{version}")


def replay(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``(id)`` of all repeats in a backlog of batches, fed in order to a new index.

    Batches go in together while they are fewer than ``GROWTH`` times the rows of the history they are
    checked against, so the history is read a logarithmic number of times. ``rows`` comes from ``keyed``, written, with batches
    that rise with the id; rows of a null batch go first.
    """
    sizes = [(r.batch, r.n) for r in rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_first("batch")).toLocalIterator()]
    index, found = History(spark), []
    calls: list[list[int | None]] = []
    history = pending = 0
    for number, n in sizes:
        if not calls or pending >= GROWTH * history:
            calls.append([])
            history, pending = history + pending, 0
        calls[-1].append(number)
        pending += n
    for numbers in calls:
        known = [n for n in numbers if n is not None]
        chosen = F.col("batch").between(known[0], known[-1]) if known else F.lit(False)
        chosen = chosen | F.col("batch").isNull() if None in numbers else chosen
        found.append(index.accept(rows.where(chosen)))
        let_go(spark)
    if not found:
        return rows.select("id").where("false")
    index.drop()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
