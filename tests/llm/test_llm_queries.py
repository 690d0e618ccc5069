"""The training-data queries over whole small tables, against SQL or slow exact forms."""

import itertools
import unicodedata
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from leadlens.functions import unify
from leadlens.llm import leakage, listing, oracle, queries, tokenize

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for file in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_p1_and_p2_equal_their_sql(spark, database):
    assert rows_of(queries.p1_found(spark, DATA)) == sorted(database.sql(oracle.P1_FOUND).fetchall())
    got = queries.p2_found(spark, DATA).select("category", "source_type")
    assert rows_of(got) == sorted(database.sql(f"select category, source_type from ({oracle.P2_FOUND})").fetchall())


def test_p2_report_and_sample_agree(spark):
    sampler = queries.p2_sampler(spark, DATA)
    report = sampler.report().collect()
    assert all(min(r.wanted, r.available) <= r.drawn <= r.available and r.gap == max(0, r.wanted - r.drawn) for r in report)
    counts = {(r.category, r.source_type): r["count"] for r in sampler.sample().groupBy("category", "source_type").count().collect()}
    assert counts == {(r.category, r.source_type): r.drawn for r in report if r.drawn}


def look(value):
    """The look of a value, character by character."""
    seen, meant = unify.look_pairs()
    table = dict(zip(seen, meant)) | unify.EXPANSIONS
    hidden = {"Cf", "Cc"}
    blanks = set("\t\n\x0b\x0c\r\x85")
    out = "".join(" " if c in blanks or unicodedata.category(c) in ("Zs", "Zl", "Zp") else "" if unicodedata.category(c) in hidden or 0xFE00 <= ord(c) <= 0xFE0F or c == "͏" else table.get(c, c) for c in value)
    return unicodedata.normalize("NFC", out).strip()


def test_p3_equals_all_pairs_by_look(spark, database):
    leads = database.sql("select ordinal, title, reason from leads where coalesce(trim(title), '') <> '' or coalesce(trim(url), '') <> '' order by ordinal").fetchall()
    want = set()
    for name, at in (("title", 1), ("reason", 2)):
        groups = defaultdict(list)
        for r in leads:
            if r[at] and look(r[at]):
                groups[look(r[at])].append((r[0], r[at]))
        for members in groups.values():
            want |= {(name, a, b) for (a, x), (b, y) in itertools.combinations(members, 2) if x != y}
    assert set(rows_of(queries.p3_found(spark, DATA))) == want


def test_p4_equals_all_pairs_of_titles_and_pages(spark, database):
    owned = {r.ordinal: r.contributor for r in queries.owned_leads(spark, DATA, "ordinal", "source", "url").collect()}
    domains = {d.lower(): s for d, s in database.sql("select domain, source from domain_dim where domain is not null").fetchall()}
    pages, titles, want = {}, [], set()
    for ordinal, title, url in database.sql("select ordinal, title, url from leads order by ordinal").fetchall():
        page, owner, own = listing.page_key(url, domains), owned[ordinal], None
        if page is not None and pages.setdefault(page, ordinal) != ordinal:
            want.add(ordinal)
        if title and owner:
            bare, cut = listing.undressed(title, owner)
            words = listing.without_site(listing.tokens(bare), owner)
            own = None if listing.only_site(words, bare, owner) else (owner, words, cut, listing.is_accessory(bare))
        if own:
            if any(alike(own, other) for other in titles):
                want.add(ordinal)
            titles.append(own)
    assert {r.ordinal for r in queries.p4_found(spark, DATA).collect()} == want


def alike(a, b):
    if a[0] != b[0]:
        return False
    (_, x, cut_x, extra_x), (_, y, cut_y, extra_y) = a, b
    if cut_x == cut_y and sorted(x) == sorted(y):
        return True
    if not cut_x and not cut_y:
        left, right = list(x), list(y)
        for w in x:
            if w in right:
                left.remove(w)
                right.remove(w)
        return len(x) > 2 and len(left) == len(right) == 1 and not (left[0][0].isdigit() or right[0][0].isdigit()) and listing.within_one(left[0], right[0])
    if cut_x == cut_y or extra_x != extra_y:
        return False
    short, whole = (x, y) if cut_x else (y, x)
    n = len(short) - 1  # the last word may be a part
    return n >= 3 and len(whole) - n <= 4 and short[:n] == whole[:n] and (whole[n] if n < len(whole) else "").startswith(short[n])


def test_p5_follows_the_votes(spark):
    items = queries.p5_items(spark, DATA).collect()
    assert items and all(r.verdict in ("like", "pass") and 0 <= r.agreement <= 1 and 0.499 <= r.confidence <= 1 for r in items)
    clear = [r for r in items if r.votes >= 3 and r.agreement == 1]
    assert all(r.confidence > 0.499 for r in clear)
    found = {r.product_id: r.reason for r in queries.p5_found(spark, DATA).collect()}
    assert found == {r.product_id: r.reason for r in items if r.votes >= 3 and r.verdict == "pass"}
    assert all(0 <= r.trust <= 1 for r in queries.p5_actors(spark, DATA).collect())


def test_p7_pairs_are_those_of_its_products(spark):
    products = defaultdict(set)
    for r in queries.p7_products(spark, DATA).collect():
        products[r["product"]].add((r.id, r.owner))
    want = {(a, b) for members in products.values() for a, x in members for b, y in members if a < b and x != y}
    assert set(rows_of(queries.p7_found(spark, DATA))) == want


def test_p8_equals_the_public_tokenizer(spark, database):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(tokenize.VOCABULARY)
    other.encode_special_tokens = True
    texts = dict(database.sql("select doc_id, text from documents").fetchall())
    got = {r.doc_id: list(r.ids) for r in queries.p8_ids(spark, DATA).collect()}
    assert got == {i: other.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}


def test_p9_does_not_depend_on_the_blocks(spark, monkeypatch):
    whole = rows_of(queries.p9_found(spark, DATA))
    monkeypatch.setattr(leakage, "BLOCK", 37)
    assert rows_of(queries.p9_found(spark, DATA)) == whole and whole


def test_p10_units_hold_every_character_once(spark, database):
    texts = dict(database.sql("select doc_id, text from documents where text is not null").fetchall())
    spans = defaultdict(list)
    for r in queries.p10_found(spark, DATA).collect():
        spans[r.doc_id].append((r.start_pos, r.end_pos))
    for doc, text in texts.items():
        found, held = sorted(spans[doc]), [False] * len(text)
        for a, b in found:
            assert not text[a].isspace() and not text[b - 1].isspace() and not any(held[a:b])
            held[a:b] = [True] * (b - a)
        assert all(h or c.isspace() for h, c in zip(held, text))


def test_p7_looks_up_each_source_once(spark, monkeypatch):
    def by_row(*_):
        raise AssertionError("sources are looked up row by row")

    monkeypatch.setattr(queries, "with_contributor", by_row)
    assert queries.p7_products(spark, DATA).count() > 0
