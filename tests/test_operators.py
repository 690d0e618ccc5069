"""Operators against brute force on small tables."""

import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from leadlens.functions import similarity, text, unify, url, values
from leadlens.functions.contributor import with_contributor, with_contributor_of
from leadlens.operators import aggregates, closeness, joins, neardup, resolution, selection, windows
from leadlens.plans import selections


def column(spark, values_, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values_)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_urls(spark):
    cases = {
        "HTTP://Shop.Example.com/a/B/?utm_source=x&id=7&b=&spm=1#frag": "http://shop.example.com/a/B?id=7",
        "//x.example/a": "https://x.example/a", "https://x.example": "https://x.example", "": "", None: "", "https://x.example/?a=1&amp;c=2": "https://x.example?a=1&c=2",
    }
    assert column(spark, list(cases), url.canonical) == list(cases.values())
    gates = {"https://a.example/search/x": True, "https://a.example/p/x": False, "https://a.example/a/b/c/tags": True, "https://a.example/x?q=1": True, "https://a.example": False}
    assert column(spark, list(gates), url.is_listing) == list(gates.values())
    assert column(spark, ["a.b.example", "example"], url.suffixes) == [["a.b.example", "b.example"], ["example"]]


def test_url_join_and_search(spark):
    base = "https://a.example/x/y?q=1#f"
    cases = {
        "https://b/c": "https://b/c", "//i/1.png": "https://i/1.png", "/z": "https://a.example/z", "z": "https://a.example/x/z", "?k=2": "https://a.example/x/y?k=2", "#g": "https://a.example/x/y?q=1#g", "": base,
    }
    assert column(spark, list(cases), lambda c: url.join(F.lit(base), c)) == list(cases.values())
    assert column(spark, ["a b*~/é"], lambda c: url.search(F.lit("s?q="), c)) == ["s?q=a+b%2A~%2F%C3%A9"]


def test_text(spark):
    assert column(spark, ["<b>A</b> &amp;  B ", None], text.strip_html) == ["A & B", ""]
    assert column(spark, ["Red Dot Design Award: Bladeless Fan For Home Lighting", "Bladeless Fan Light"], text.title_tokens) == [["bladeles", "fan", "light"]] * 2
    assert column(spark, ["1.2万", "3k likes", "980", "none", None], text.like_count) == [12000, 3000, 980, 0, 0]
    assert column(spark, ["创意水杯", "创意 Cup: A@B[1]"], text.compat_key) == ["", "cup:a@b[1"]
    assert column(spark, ["Site - Name", "Name"], lambda c: text.clean_title(c, ["site"])) == ["Name", "Name"]


def test_unify(spark):
    assert column(spark, ["Ｃｒｏｗｄ Аnvіl", "Werkstück", None, "​"], unify.loose_key) == ["crowdanvil", "werkstuck", None, None]
    assert column(spark, ["oﬃce…", "⽔杯"], unify.same_look) == ["office...", "水杯"]


def test_contributor(spark):
    sources = spark.createDataFrame([("Crowd Anvil",), ("Werkstück",)], "source string")
    domains = spark.createDataFrame([("anvil.example", 1, "Crowd Anvil"), ("m.anvil.example", 2, "Crowd Anvil")], "domain string, ord int, source string")
    rows = [
        ("CROWD  ANVIL", None, "k"), ("www.anvil.example", None, "k"), (None, "https://WWW.m.anvil.example:443/x", "k"), ("unknown", "http://anvil.example", "k"), ("", None, "k"),
        ("Werkstück", "https://anvil.example", "k"), ("Other", "https://anvil.example", "k"), (None, "https://else.example", "k"),
    ]
    made = with_contributor(spark.createDataFrame(rows, "source string, url string, _ck string"), sources, domains)
    assert made.columns == ["source", "url", "_ck", "contributor"]
    got = {(r.source, r.url): r.contributor for r in made.collect()}
    assert [got[r[:2]] for r in rows] == ["Crowd Anvil"] * 4 + [None, "Werkstück", None, None]


def test_contributor_by_spelling(spark):
    sources = spark.createDataFrame([("Crowd Anvil",), ("Werkstück",)], "source string")
    domains = spark.createDataFrame([("anvil.example", 1, "Crowd Anvil"), ("werk.example", None, "Werkstück")], "domain string, ord int, source string")
    spelled = ["CROWD  ANVIL", "Ｃｒｏｗｄ Аnvіl", "www.anvil.example", "https://werk.example/x", "unknown", "Unknown ", "", " ", None, "Werkstück", "Other", "@anvil.example"]
    urls = [None, "", "https://WWW.anvil.example:443/x", "http://else.example", "//werk.example"]
    rows = spark.createDataFrame([(s, u, i) for i, s in enumerate(spelled) for u in urls] * 2, "source string, url string, n int")
    by_row = with_contributor(rows, sources, domains)
    by_spelling = with_contributor_of(rows, rows.select("source").distinct(), sources, domains)
    assert by_spelling.columns == by_row.columns
    told = lambda frame: Counter(tuple(r) for r in frame.collect())
    assert told(by_spelling) == told(by_row)


def test_values(spark):
    assert column(spark, [2.5, 3.5, 200.0, None], lambda c: values.clamp(c, 0, 100), "double") == [2, 4, 100, 0]
    assert column(spark, ["2026-12-31", "2026-08-21"], lambda c: values.iso_week(F.to_date(c))) == ["2026-W53", "2026-W34"]
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(similarity.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 0.0]


def test_windows_and_joins(spark):
    rows = spark.createDataFrame([(1, "x", 5), (2, "x", 7), (3, "y", None), (4, None, 1)], "o int, k string, s int")
    assert sorted(r.o for r in windows.keep_first(rows, ["k"], [F.col("o")]).collect()) == [1, 3, 4]
    assert sorted(r.o for r in windows.keep_last(rows, ["k"], [F.col("o")]).collect()) == [2, 3, 4]
    assert sorted(r.o for r in windows.top_k(rows, ["k"], [F.desc_nulls_last("s")], 1).collect()) == [2, 3, 4]
    assert sorted(r.o for r in joins.fresh(rows, rows.where("o = 1"), "k").collect()) == [3, 4]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert sorted((r.id, r.v) for r in joins.upsert(old, new, "id").collect()) == [(1, "a"), (2, None), (3, "c")]
    state = aggregates.first_seen(old.select("id", "v"), new.select("id", "v"), "id", "v")
    assert sorted((r.id, r.v) for r in state.collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_components_against_union_find(spark):
    rng = random.Random(4)
    rows = [(i, [f"k{rng.randrange(150)}" for _ in range(rng.randrange(3))] + rng.choice([[""], [None], []])) for i in range(200)]
    rows += [(1000 + i, [f"c{i}", f"c{i + 1}"]) for i in range(60)]  # a long chain
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for i, keys in rows:
        for k in filter(None, keys):
            a, b = find(i), find(seen.setdefault(k, i))
            parent[max(a, b)] = min(a, b)
    made = resolution.components(spark.createDataFrame(rows, "id int, keys array<string>"), "id", "keys")
    assert {r.id: r.component for r in made.collect()} == {i: find(i) for i, _ in rows}
    assert resolution.components(spark.createDataFrame([], "id int, keys array<string>"), "id", "keys").count() == 0


def test_jaccard_pairs_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), [f"t{rng.randrange(12)}" for _ in range(rng.randrange(7))]) for i in range(150)]
    reps = {}
    for i, block, tokens in rows:
        reps.setdefault((block, tuple(sorted(set(tokens)))), i)
    sets = [(i, b, set(t)) for (b, t), i in reps.items() if len(t) >= 2]
    for threshold in (0.5, 0.6, 0.8, 1.0):
        want = {(min(i, j), max(i, j)) for i, b, s in sets for j, c, t in sets if i < j and b == c and len(s & t) / len(s | t) >= threshold}
        made = neardup.jaccard_pairs(spark.createDataFrame(rows, "id int, block string, tokens array<string>"), "id", "block", F.col("tokens"), threshold)
        assert {(r.a, r.b) for r in made.collect()} == want


def test_blank_blocks_and_classes_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "", None]), [f"t{rng.randrange(9)}" for _ in range(rng.randrange(6))]) for i in range(120)]
    made = spark.createDataFrame(rows, "id int, block string, tokens array<string>")
    reps = {}
    for i, block, tokens in rows:
        reps.setdefault((block or "", tuple(sorted(set(tokens)))), i)
    sets = [(i, b, set(t)) for (b, t), i in reps.items() if len(t) >= 2]
    for threshold in (0.6, 1.0):
        want = {(i, j) for i, b, s in sets for j, c, t in sets if i < j and not (b and c) and len(s & t) / len(s | t) >= threshold}
        assert {(r.a, r.b) for r in neardup.blank_pairs(made, "id", "block", F.col("tokens"), threshold).collect()} == want


@pytest.mark.parametrize("some", [False, True])
def test_common_tokens_make_few_candidates_and_lose_no_pair(spark, monkeypatch, some):
    monkeypatch.setattr(neardup, "COMMON", 4)
    rng = random.Random(12)
    rows = []
    for i in range(500):
        tokens = [f"{k}{rng.randrange(2)}" for k in rng.sample("abcdefgh", rng.randrange(2, 8))] + [f"own{rng.randrange(400)}" for _ in range(2)]
        if i and rng.random() < 0.3:
            tokens = rng.choice(rows)[2][1:] + [f"own{rng.randrange(400)}"]
        rows.append((i, "" if some and rng.random() < 0.3 else "x", tokens))
    reps = {}
    for i, block, tokens in rows:
        reps.setdefault((block, tuple(sorted(set(tokens)))), i)
    sets = [(i, b, set(t)) for (b, t), i in reps.items()]
    want = {(i, j) for i, b, s in sets for j, c, t in sets if i < j and (not (b and c) if some else b == c) and len(s & t) / len(s | t) >= 0.6}
    made = spark.createDataFrame(rows, "id int, block string, tokens array<string>")
    pairs = (neardup.blank_pairs if some else neardup.jaccard_pairs)(made, "id", "block", F.col("tokens"), 0.6)
    assert len(want) > 20 and {(r.a, r.b) for r in pairs.collect()} == want
    space = F.lit(0).cast("long").alias("space")
    tried = neardup._candidates(neardup._representatives(made, "id", "block", F.col("tokens"), 2).select("id", space, (F.col("block") == "").alias("counted") if some else F.lit(True).alias("counted"), "tokens"), 0.6, some)
    assert want <= {(r.a, r.b) for r in tried.collect()} and tried.count() < len(sets) * 4


def test_gestalt_matches_against_brute_force(spark):
    rng = random.Random(6)
    texts = ["gegapuha tumbler", "gegapuhb tumbles", "tumbler gegapuha", "磁吸盖动态雕塑旋转环台灯", "磁吸盖动态雕塑旋转环桌灯", "aaaaaaaaaaaa", "aaaaaaaaaaab", "abababababab", "short", "", None]
    for _ in range(90):
        base = list(rng.choice(texts[:8]) if rng.random() < 0.5 else "".join(rng.choice("abc ") for _ in range(rng.randrange(8, 40))))
        texts.append("".join(base))
        for _ in range(2):
            for _ in range(rng.randrange(1, 4)):
                base[rng.randrange(len(base))] = rng.choice(["", "a", "x", "bc", "灯"])
            texts.append("".join(base))
    rows = [(i, rng.choice(["a", "b", "", None]), t) for i, t in enumerate(texts)]
    least = {}
    for i, block, t in rows:
        if t and len(t) >= 8:
            least.setdefault((block or "", t), i)
    kept = sorted((i, b, t) for (b, t), i in least.items())
    near = lambda s, t: min(len(s), len(t)) >= 0.72 * max(len(s), len(t)) and SequenceMatcher(None, s, t).ratio() >= 0.9
    want = {(i, j) for i, b, s in kept for j, c, t in kept if i < j and (b == c or not (b and c)) and near(s, t)}
    made = neardup.gestalt_matches(spark.createDataFrame(rows, "id int, block string, w string"), "id", "block", "w")
    assert len(want) > 50 and sorted((r.a, r.b) for r in made.collect()) == sorted(want)


def test_texts_of_one_template_make_few_candidates_in_any_number_of_tiles_and_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(closeness, "TILE", 40)
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "ru", "te", "zo", "fa", "ni"]
    coined = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    texts = []
    for i in range(420):
        base = [f"{coined(2)} {coined(3)} borosilicate glas water bottle", f"{coined(4)} 磁吸盖的高硼硅玻璃手提灯编号{i % 7}", f"{coined(6)} {'reusable sleeve '* 6}", f"{coined(4)} {'premium cork gift box '* 14}", f"{coined(2)}{'stand desk '* 60}"][(i % 25) // 12 if i % 40 else rng.randrange(5)]
        texts.append(base)
        if i % 6 == 0:
            k = rng.randrange(len(base))
            texts.append(base[:k] + rng.choice(["", "x", "灯", base[k] * 2]) + base[k + 1 :])
    rows = [(i, rng.choice(["a", "a", "a", "b", ""]), t) for i, t in enumerate(texts)]
    least = {}
    for i, block, t in rows:
        least.setdefault((block, t), i)
    kept = sorted((i, b, t) for (b, t), i in least.items())
    fits = lambda s, t: 11 * min(len(s), len(t)) >= 9 * max(len(s), len(t)) and sum(((c := Counter(s)) & Counter(t)).values()) * 20 >= 9 * (len(s) + len(t))
    want = {(i, j): r for i, b, s in kept for j, c, t in kept if i < j and (b == c or not (b and c)) and fits(s, t) and (r := SequenceMatcher(None, s, t).ratio()) >= 0.9}
    made = spark.createDataFrame(rows, "id int, block string, w string")
    found = neardup.gestalt_matches(made, "id", "block", "w").collect()
    assert len(want) > 100 and len(found) == len(want) and {(r.a, r.b): r.ratio for r in found} == want
    tried = closeness.close_texts(made.groupBy("block", "w").agg(F.min("id").alias("id")).select("id", "block", "w")).collect()
    assert all(r.a < r.b for r in tried) and want.keys() <= {(r.a, r.b) for r in tried} and len(tried) < 2 * len(want)
    assert closeness.close_texts(made.where("false").select("id", "block", "w")).count() == 0


def test_links_of_duplicates_are_written_kind_by_kind(spark):
    d = "/root/testdata/sf0.001"
    links = selections.duplicate_links(spark, d)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and links.where("a <> b").count() == links.count() > 0
    made = {r.ordinal: r for r in selections.duplicate_products(spark, d).collect()}
    assert all(made[r.a].component == made[r.b].component for r in links.collect())


def test_capped_selection_against_a_greedy_walk(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("de"), rng.choice("ABC"), rng.choice("xyz"), rng.choice([None, 1, 2, 3])) for i in range(200)]
    made = selection.capped_selection(spark.createDataFrame(rows, "id int, day string, cat string, src string, s int"), "day", {"cat": 4, "src": 3}, 8, [F.desc_nulls_last("s"), F.asc("id")], "id")
    want = []
    for day in "de":
        used, n = defaultdict(int), 0
        for i, _, c, s, _v in sorted((r for r in rows if r[1] == day), key=lambda r: (-(r[4] or -1), r[0])):
            if n < 8 and used["c", c] < 4 and used["s", s] < 3:
                used["c", c] += 1
                used["s", s] += 1
                n += 1
                want.append((day, n, i))
    assert sorted((r.day, r.place, r.id) for r in made.collect()) == sorted(want)
