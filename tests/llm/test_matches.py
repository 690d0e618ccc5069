"""Repeats, consensus and product matching."""

import random

from pyspark.sql import functions as F

from leadlens.llm import consensus, history, listing, matching

SHOP = "Quiet Object"
FIRST = "Pellova GegaPuha 650 ml Bamboo Travel Mug"
TITLES = [
    (1, FIRST, "https://a.example/p/x1", SHOP, False),
    (2, FIRST.upper(), "https://a.example/p/x2", SHOP, True),
    (3, "Re-post: " + FIRST + " | Quiet Object", None, SHOP, True),
    (4, "Pellova GegaPhua 650 ml Bamboo Travel Mug (2026)", "https://a.example/p/x4", SHOP, True),
    (5, "Pellova GegaPuha 650 ml Bamboo Travel...", "https://a.example/p/x5", SHOP, True),
    (6, "Pellova GegaPuha 850 ml Bamboo Travel Mug", "https://a.example/p/x6", SHOP, False),
    (7, "Pellova Zuhodima 650 ml Bamboo Travel Mug", "https://a.example/p/x7", SHOP, False),
    (8, FIRST + ": lid only", "https://a.example/p/x8", SHOP, False),
    (9, FIRST, "https://b.example/p/x9", "Trend Kiln", False),
    (10, "Other words", "HTTP://www.A.example/p/x1/?utm_source=f&spm=1#top", SHOP, True),
    (11, "Home – Quiet Object", "https://a.example/p/x11", SHOP, False),
    (12, "Home – Quiet Object", "https://a.example/p/x12", SHOP, False),
    (13, None, "https://a.example/p/x12", SHOP, True),
    (14, "", None, SHOP, False),
    (15, None, None, None, False),
    (16, FIRST, None, None, False),
    (17, "Ｐellova Ｇega​Puha 650 ml Bamboo Travel Mug", "https://a.example/p/x17", SHOP, True),
    (18, "Pellova GegaPuha 650 ml Bamboo Mug Travel", "https://a.example/p/x18", SHOP, True),
    (19, "y " * 20_000, "https://a.example/p/x19", SHOP, False),
]
SCHEMA = "ordinal long, title string, url string, owner string, key long"


def _run(spark, cuts):
    rows = [(o, t, u, w, 0) for o, t, u, w, _ in TITLES]
    index, found = history.History(spark), set()
    edges = [0, *cuts, 100]
    for low, high in zip(edges, edges[1:]):
        part = spark.createDataFrame([r for r in rows if low <= r[0] < high], SCHEMA)
        keyed = history.keyed(part, "ordinal", "title", "url", "owner", {"a.example": SHOP})
        found |= {r.id for r in index.accept(keyed).collect()}
    index.drop()
    return found


def test_repeats_do_not_depend_on_the_batches(spark):
    want = {o for o, *_, repeat in TITLES if repeat}
    assert _run(spark, []) == want
    assert _run(spark, [2, 5, 13]) == want
    empty = history.keyed(spark.createDataFrame([], SCHEMA), "ordinal", "title", "url", "owner", {})
    assert history.History(spark).accept(empty).count() == 0


def test_index_is_found_again_grows_by_new_keys_only_and_compacts(spark):
    rows = [(o, t, u, w, 0) for o, t, u, w, _ in TITLES]
    keys = lambda part: history.keyed(spark.createDataFrame(part, SCHEMA), "ordinal", "title", "url", "owner", {"a.example": SHOP})
    first = history.History(spark, buckets=3)
    first.accept(keys(rows[:4]))
    first.close()
    sizes = lambda index: {t: index.table(t).count() for t in history.TABLES}
    again = history.History(spark, first.path)
    before = sizes(again)
    copies = [(o + 100, t, u, w, 0) for o, t, u, w, _ in rows[:4]]
    assert sorted(r.id for r in again.accept(keys(copies)).collect()) == [101, 102, 103, 104]
    assert sizes(again) == before
    assert {r.id for r in again.accept(keys(rows[:4])).collect()} == {o for o, *_, repeat in TITLES[:4] if repeat}  # a batch given again
    again.compact()
    assert sizes(again) == before
    again.close()
    third = history.History(spark, first.path)
    assert third.state == {"buckets": 3, "version": 1, "step": 1}
    want = {o for o, *_, repeat in TITLES[4:] if repeat}
    assert {r.id for r in third.accept(keys(rows[4:])).collect()} == want
    third.drop()


def test_replay_of_batches_equals_one_call(spark):
    rows = [(o, t, u, w, o // 3 if o > 2 else None) for o, t, u, w, _ in TITLES]
    keys = history.keyed(spark.createDataFrame(rows, SCHEMA), "ordinal", "title", "url", "owner", {"a.example": SHOP}, "key")
    assert {r.id for r in history.replay(spark, keys).collect()} == {o for o, *_, repeat in TITLES if repeat}
    assert history.replay(spark, keys.limit(0)).count() == 0


def test_the_index_is_not_shuffled(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(history, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    index = history.History(spark, buckets=4)
    keys = history.keyed(spark.createDataFrame([(o, t, u, w, 0) for o, t, u, w, _ in TITLES], SCHEMA), "ordinal", "title", "url", "owner", {})
    index.accept(keys)
    assert "Exchange" not in plans[0] and plans[0].count("Bucketed: true") == 2
    index.drop()


def test_titles_of_repeated_pages_stay_in_the_index(spark):
    title = "Pellova Zuhodima 850 ml Steel Travel Mug"
    rows = [
        (1, "Home – Quiet Object", "https://a.example/p/y1", SHOP), (2, title, "https://a.example/p/y1?utm_source=f", SHOP),
        (3, title.replace("dima", "dmia"), "https://a.example/p/y3", SHOP), (4, title, "https://a.example/p/y4", SHOP),
        (5, "Home – Quiet Object", "https://a.example/p/y5", SHOP), (6, "Pellova Kedarupo 650 ml Bamboo Desk...", "https://a.example/p/y5", SHOP),
        (7, "Pellova Kedarupo 650 ml Bamboo Desk Lamp", "https://a.example/p/y7", SHOP),
        (8, "Home – Quiet Object", "https://a.example/p/y8", SHOP), (9, "Pellova Kedarupo 650 ml Lamp Desk Bamboo", "https://a.example/p/y8", SHOP),
        (10, "Pellova Kedarupo 650 ml Lamp...", "https://a.example/p/y10", SHOP), *((o, None, f"https://a.example/p/y{o}", SHOP) for o in range(11, 17)),
    ]
    for calls in (1, 3, 8):
        index, found, step = history.History(spark), set(), -(-len(rows) // calls)
        for i in range(0, len(rows), step):
            part = spark.createDataFrame(rows[i : i + step], "ordinal long, title string, url string, owner string")
            found |= {r.id for r in index.accept(history.keyed(part, "ordinal", "title", "url", "owner", {})).collect()}
        index.drop()
        assert found == {2, 3, 4, 6, 7, 9, 10}, calls


def test_a_misspelled_word_may_be_the_one_that_tells_an_accessory(spark):
    rows = [(1, "Replacement lid for Pellova GegaPuha 650 ml", None, SHOP), (2, "Relacement lid for Pellova GegaPuha 650 ml", None, SHOP), (3, "Pellova GegaPuha 650 ml: lid olny", None, SHOP), (4, "Pellova GegaPuha 650 ml: lid only", None, SHOP)]
    keys = history.keyed(spark.createDataFrame(rows, "ordinal long, title string, url string, owner string"), "ordinal", "title", "url", "owner", {})
    index = history.History(spark)
    assert {r.id for r in index.accept(keys).collect()} == {2, 4}
    index.drop()


def test_within_one():
    assert all(listing.within_one(a, b) for a, b in [("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("ab", "axb"), ("abc", "axc")])
    assert not any(listing.within_one(a, b) for a, b in [("abcd", "badc"), ("abc", "a"), ("abc", "xyc")])


def test_sizes():
    near = lambda text: [(k, round(v)) for k, v in listing.sizes(text)]
    assert near("0.65 l and 650ml, 10.2 in, 4000 mah") == [("amount", 650), ("amount", 650), ("length", 259), ("charge", 4000)]
    assert near("规格26厘米，1.1千克") == [("length", 260), ("amount", 1100)]


def test_consensus_beats_the_majority_and_finds_kinds(spark):
    rng = random.Random(5)
    truth = {f"p{i}": rng.choice(["like", "low_margin", "bad_evidence"]) for i in range(300)}
    kinds = {f"good{i}": 0.93 for i in range(6)} | {f"bad{i}": 0.1 for i in range(4)} | {f"rnd{i}": 0.5 for i in range(3)}
    votes = []
    for product, real in truth.items():
        for actor in rng.sample(sorted(kinds), 8):
            right = rng.random() < kinds[actor]
            passed = (real != "like") == right
            reason = (real if real != "like" and rng.random() < kinds[actor] else rng.choice(consensus.REASONS)) if passed else ""
            votes.append((actor, product, " Pass" if passed else "LIKE", reason.upper().replace("_", "-"), "x"))
    votes += [(None, "p1", "like", "", "x"), ("good1", None, "like", "", "x"), ("good1", "px", "view", "", "x"), ("good1", "only", "pass", "other", "x")]
    made = consensus.Consensus(spark.createDataFrame(votes, "actor string, product string, action string, reason string, label string"), "actor", "product", "action", "reason")
    found = {r.item: r for r in made.items().collect()}
    assert set(found) == set(truth) | {"only"}
    assert found["only"].verdict == "pass" and found["only"].reason is None
    assert sum((found[p].verdict == "pass") == (t != "like") for p, t in truth.items()) >= 285
    reasons = [(found[p].reason, t) for p, t in truth.items() if t != "like" and found[p].verdict == "pass"]
    assert sum(a == b for a, b in reasons) >= 0.9 * len(reasons)
    trust = {r.annotator: r.trust for r in made.annotators().collect()}
    assert min(trust[a] for a in trust if a.startswith("good")) > 0.75 > 0.4 > max(trust[a] for a in trust if a.startswith("bad"))


def test_consensus_empty(spark):
    none = spark.createDataFrame([], "actor string, product string, action string, reason string")
    made = consensus.Consensus(none, "actor", "product", "action", "reason", rounds=2)
    assert made.items().count() == 0 and made.annotators().count() == 0


LISTING = "row long, id string, owner string, category string, title string, reason string, url string, name string"


def test_matching(spark):
    lead = lambda row, owner, title, reason=None, id=None, url=None: (row, id or f"i{row:03}", owner, "cup", title, reason, url, "x")
    rows = [
        lead(1, "A", "Pellova GegaPuha 650 ml Bamboo Travel Mug", "The page shows a travel mug of bamboo."),
        lead(2, "B", "保温杯｜Pellova Gega-puha·双层壁·0.65升"),
        lead(3, "C", "Travel Mug: GEGAPUHA by Pellova, 22.0 fl oz"),
        lead(4, "C", "Travel Mug: GegaPuha by Pellova, 850 ml"),
        lead(5, "D", "Replacement lid for Pellova Gegapuha 650 ml Travel Mug"),
        lead(6, "D", "PE-2DHEX 650 ml travel mug", "Model PE-2DHEX, also known as Gegapuha."),
        lead(7, "E", "Pellova PE-2DHEX 650ml travel mug"),
        lead(8, "A", "Pellova GegaPuha 650 ml Bamboo Travel Mug", id="i900"),
        lead(9, None, "Pellova GegaPuha 650 ml Bamboo Travel Mug"),
        lead(10, "B", None), lead(11, "B", "", ""), lead(12, "B", "x" * 30_000),
        lead(13, "F", "Home – F", "Pellova Gega Puha: a travel mug, 650ml."),
        lead(14, "G", "A mug of 650 ml", url="https://g.example/p/gegapuha-travel-mug-1x"),
        (15, None, "A", "cup", "Pellova GegaPuha 650 ml", None, None, "x"),
        lead(1, "A", "Pellova GegaPuha 650 ml Bamboo Travel Mug", "The page shows a travel mug of bamboo."),
    ]
    found = matching.pairs(matching.clusters(spark.createDataFrame(rows, LISTING)))
    got = {(r.id_a, r.id_b) for r in found.collect()}
    members = {"i001": "A", "i002": "B", "i003": "C", "i006": "D", "i007": "E", "i900": "A", "i013": "F", "i014": "G"}
    assert got == {(a, b) for a in members for b in members if a < b and members[a] != members[b]}
    assert found.groupBy("id_a", "id_b").count().where(F.col("count") > 1).count() == 0
    assert matching.clusters(spark.createDataFrame([], LISTING)).count() == 0


def test_matching_does_not_depend_on_the_partitions(spark):
    titles = ["GegaPuha 650 ml, a mug", "Mug: Gegapuha 0.65 l", "the gegapuha", "GEGAPUHA (650ml)", "Gegapuha mug, 650 ml", "a mug", "Gegapuha", "A mug: Gegapuha", "x", "y", "z", "w"]
    rows = [(i, f"i{i:03}", f"owner {i}", "cup", t, None, None, "x") for i, t in enumerate(titles)]
    one, twelve = (
        {(r.id_a, r.id_b) for r in matching.pairs(matching.clusters(spark.createDataFrame(spark.sparkContext.parallelize(rows, n), LISTING))).collect()} for n in (1, 12)
    )
    assert one == twelve
    named = ["i000", "i001", "i002", "i003", "i004", "i006", "i007"]
    assert ("i000", "i001") in one and one <= {(a, b) for a in named for b in named if a < b}


def test_names_without_any_size_are_products(spark):
    titles = ["GegaPuha charger, 65 W", "Charger: Gegapuha", "GEGAPUHA", "Zuhodima mug, 650 ml", "Mug: Zuhodima, 850 ml", "Zuhodima", "Mug: Zuhodima 0.65 l", "Tavomiri", "Tavomiri 20 cm"]
    rows = [(i, f"i{i:03}", f"owner {i}", "x", t, None, None, "x") for i, t in enumerate(titles)]
    found = matching.pairs(matching.clusters(spark.createDataFrame(rows, LISTING)))
    assert {(r.id_a, r.id_b) for r in found.collect()} == {("i000", "i001"), ("i000", "i002"), ("i001", "i002"), ("i003", "i006"), ("i007", "i008")}


def test_names_in_other_scripts_and_misspelled_ones(spark):
    titles = {
        "i01": "小熊保温杯 650毫升", "i02": "【新品】小熊 保温杯 0.65升", "i03": "虎牌保温杯 650毫升", "i04": "小熊保温杯 350毫升",
        "i11": "GegaPuha charger, 65 W", "i12": "Charger: GegaPhua", "i13": "GegaPoha charger", "i14": "Gegapuha",
        "i21": "Limi mug, 300 ml", "i22": "Mug: Limi 0.3 l", "i23": "Limi mug, 500 ml",
    }
    rows = [(i, k, f"owner {i}", k[:2], t, None, None, "x") for i, (k, t) in enumerate(titles.items())]
    found = {(r.id_a, r.id_b) for r in matching.pairs(matching.clusters(spark.createDataFrame(rows, LISTING))).collect()}
    assert found == {("i01", "i02"), ("i11", "i12"), ("i11", "i14"), ("i12", "i14"), ("i21", "i22")}


def test_aliases_are_followed_to_their_end(spark):
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "name string, as string")
    assert {(r.name, r["as"]) for r in matching.last_of(chain).collect()} == {("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")}


def test_reading_a_listing():
    words = []
    found = matching.read("Brölo-Kasi ＬＡＭＰ lamp, Caldini 1.1 kg", "an ABC lamp, spare", "https://x.example/p/kasibrolo-lamp-1", words)
    assert found == (["brolokasi", "caldini", "/kasibrolo"], "amount", 1100.0, False, [])
    assert sorted(words) == ["ABC", "Brolo-Kasi", "Caldini", "LAMP", "an", "kg", "lamp", "spare"]
    table = listing._table()
    assert all(listing.plain(f"水{c}é{c}") == f"水{c}é{c}".translate(table) for c in map(chr, [*table, 0x6C34, 0x1F600]))
    assert listing.is_accessory("杯盖配件") and listing.is_accessory("lid only") and not listing.is_accessory("水杯 lonely")
