"""Capping, sampling and same-look classes against brute force, with dirty rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlens.llm import capping, lookalike, sampling

ROWS = "ordinal long, batch int, owner string, score double, _room string, kept string"


def expected_drops(rows, share):
    size = Counter(r[1] for r in rows)
    groups = defaultdict(list)
    for r in rows:
        if r[2] is not None:
            groups[r[1], r[2]].append(r)
    out = []
    for (batch, _), members in groups.items():
        key = lambda r: ((1, 0.0) if r[3] is None or math.isnan(r[3]) else (0, -r[3]), r[0])
        out += [r[0] for r in sorted(members, key=key)[size[batch] // share :]]
    return sorted(out)


def few_scores(rng):
    return rng.choice([None, float("nan"), 0.0, -0.0, 1.5, 2.5])


def many_scores(rng):
    return rng.choice([rng.uniform(-3, 3), rng.uniform(0.5, 0.5000001), rng.gauss(0, 1e200), 5e-324, float("inf"), float("-inf"), None, 0.0])


@pytest.mark.parametrize("block,fine,scores", [(1 << 16, 1 << 16, few_scores), (7, 4, few_scores), (1 << 16, 1 << 16, many_scores), (7, 4, many_scores)])
def test_capped_against_brute_force(spark, block, fine, scores, monkeypatch):
    monkeypatch.setattr(capping, "BLOCK", block)
    monkeypatch.setattr(capping, "FINE", fine)
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 2, None]), rng.choice(["hot", "hot", "hot", "b", "c", None]), scores(rng), "x", "y") for i in range(600)]
    got = capping.capped(spark.createDataFrame(rows, ROWS), "batch", "owner", "score", "ordinal", share=5)
    assert got.columns == ["ordinal", "batch", "owner", "score", "_room", "kept"]
    assert got.count() == 600
    assert sorted(r.ordinal for r in got.where("not kept").collect()) == expected_drops(rows, 5)


def test_capped_empty_and_repeated_rows(spark):
    assert capping.capped(spark.createDataFrame([], ROWS), "batch", "owner", "score", "ordinal").count() == 0
    twice = spark.createDataFrame([(1, 1, "a", 1.0, "", "")] * 2 + [(i, 1, "a", 1.0, "", "") for i in range(2, 22)], ROWS)
    got = capping.capped(twice, "batch", "owner", "score", "ordinal", share=20)
    assert [r.ordinal for r in got.where("kept").select("ordinal").distinct().collect()] == [1]


LEADS = "id string, category string, source_type string, cell string"
TARGETS = "category string, source_type string, target_bp int, min_rows int"


def test_sampler_reports_and_draws(spark):
    rows = [(f"a{i}", " Cup", "Big_Shop", "z") for i in range(400)] + [(f"b{i}", "cup", "small-shop ", "z") for i in range(97)]
    rows += [(f"c{i}", "Ｌａｍｐ", "big shop", "z") for i in range(3)] + [(None, "cup", "big_shop", "z"), ("d", None, "big_shop", "z"), ("a1", "cup", "big_shop", "z")]
    targets = spark.createDataFrame([("cup", "big_shop", 5000, 1), ("cup", "small_shop", 4000, 1), ("lamp", "big_shop", 1000, 2), ("vase", "big_shop", 0, 1)], TARGETS)
    made = sampling.Sampler(spark.createDataFrame(rows, LEADS), targets)
    report = {(r.category, r.source_type): r for r in made.report().collect()}
    assert {k: (r.wanted, r.available, r.gap) for k, r in report.items()} == {
        ("cup", "big_shop"): (50, 400, 0), ("cup", "small_shop"): (40, 97, 0), ("lamp", "big_shop"): (10, 3, 7), ("vase", "big_shop"): (1, 0, 1),
    }
    drawn = made.sample().collect()
    assert len({r.id for r in drawn}) == len(drawn)
    shares = Counter((r.category, r.source_type) for r in drawn)
    # the lamps and the vase that are missing go to the other cell of their shop
    assert shares == {("cup", "big_shop"): 58, ("cup", "small_shop"): 40, ("lamp", "big_shop"): 3}
    assert {k: r.drawn for k, r in report.items()} == {**shares, ("vase", "big_shop"): 0}
    assert sorted(r.id for r in drawn) == sorted(r.id for r in made.sample().collect())


def test_raking_keeps_bounds_and_margins():
    rng = np.random.default_rng(4)
    for _ in range(50):
        rows, columns = (a.ravel() for a in np.indices((6, 5)))
        wanted, have = rng.integers(0, 60, 30).astype(float), rng.integers(0, 400, 30)
        least = np.minimum(wanted, have)
        got = sampling.raked(wanted, least, have, [rows, columns])
        assert (got >= least).all() and (got <= have).all()
        if (have >= wanted).all():
            assert (got == wanted).all()
    plenty = sampling.raked(np.array([10.0, 20, 30, 40]), np.zeros(4), np.array([5, 999, 999, 999]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])])
    assert np.bincount([0, 0, 1, 1], plenty).tolist() == [30, 70] and np.bincount([0, 1, 0, 1], plenty).tolist() == [40, 60]


def test_sampler_empty(spark):
    targets = spark.createDataFrame([("cup", "shop", 10000, 3)], TARGETS)
    made = sampling.Sampler(spark.createDataFrame([], LEADS), targets)
    assert [(r.wanted, r.gap) for r in made.report().collect()] == [(3, 3)]
    assert made.sample().count() == 0


def test_same_look_pairs(spark):
    values = [
        "Café Lamp", "Café Lamp", "Café Lamp", "Ｃａｆé Ｌａｍｐ", "Сafé Lamp", "Caf​é Lamp", "Cafe Lamp", "café Lamp", "Café, Lamp", "Café Lamp",
        "oﬃce", "office", "⽔杯", "水杯", None, "", " ", "​", "x" * 50_000, "x" * 49_999 + "х",
    ]
    rows = spark.createDataFrame([(i, v, v, "q") for i, v in enumerate(values)], "ordinal long, title string, reason string, look string")
    got = {(r.a, r.b) for r in lookalike.pairs(rows, "ordinal", ["title", "reason"]).where("field = 'title'").collect()}
    alike = [0, 1, 2, 3, 4, 5, 9]
    want = {(a, b) for a in alike for b in alike if a < b and values[a] != values[b]} | {(10, 11), (12, 13), (18, 19)}
    assert got == want
    made = lookalike.unified(rows, "ordinal", ["title"]).collect()
    assert len(made) == len(values)
    canonical = {r.id: r.canonical for r in made}
    assert len({canonical[i] for i in alike}) == 1 and canonical[6] == "Cafe Lamp" and canonical[14] is None


def test_same_look_empty(spark):
    rows = spark.createDataFrame([], "ordinal long, title string")
    assert lookalike.pairs(rows, "ordinal", ["title"]).count() == 0
    assert rows.select(F.lit(1)).count() == 0
