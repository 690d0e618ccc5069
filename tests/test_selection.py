"""Selections against brute force, with nulls, ties, repeated keys and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from leadlens.operators import selection

SCHEMA = "day string, key string, ordinal int, category string, source string, family string, score int, place int"
CAPS = {"category": ({"a": 3}, 2), "source": ({}, 3)}


def pick_slowly(rows, limit, minimums, quotas, balance):
    """A pick that looks at all rows, written as the rules say."""
    rows = sorted(rows, key=lambda r: (-(r["score"] if r["score"] is not None else -1), r["ordinal"]))
    out, seen = [], set()
    count = lambda c, v: sum(r[c] == v for r in out)

    def fits(r):
        return r["key"] not in seen and all(count(c, r[c]) < table.get(r[c], rest) for c, (table, rest) in CAPS.items())

    def take(r):
        seen.add(r["key"])
        out.append(r)

    for value, n in minimums.items():
        for r in rows:
            if count("category", value) < n and r["category"] == value and fits(r):
                take(r)
    for value, n in quotas.items():
        for r in rows:
            if count("family", value) >= n:
                break
            if r["family"] == value and fits(r):
                take(r)
                if len(out) >= limit:
                    break
        if len(out) >= limit:
            break
    while len(out) < limit:
        left = [(tuple(count(b, r[b]) for b in balance), i) for i, r in enumerate(rows) if fits(r)]
        if not left:
            break
        take(rows[min(left)[1]])
    return [r["ordinal"] for r in out]


@pytest.mark.parametrize("seed", range(4))
def test_constrained_selection(spark, seed):
    rng = random.Random(seed)
    names = SCHEMA.replace(",", "").split()[::2]
    rows = [
        dict(zip(names, (rng.choice("xy"), f"k{rng.randrange(60)}", i, rng.choice(["a", "b", "c", "d", None]), rng.choice("pqrs"), rng.choice("uvw"), rng.choice([None, 1, 2, 3]), 7)))
        for i in range(150)
    ]
    minimums, quotas, balance, limit = {"b": 2, "a": 1}, {"v": 2, "u": 3}, ("category", "family"), 9
    table = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    order = [(F.col("score"), True), F.col("ordinal")]
    got = selection.constrained_selection(table, "day", "key", "ordinal", order, limit, CAPS, ("category", minimums), ("family", quotas), balance).collect()
    for day in "xy":
        found = [r.ordinal for r in sorted((r for r in got if r.day == day), key=lambda r: r.place)]
        assert found == pick_slowly([r for r in rows if r["day"] == day], limit, minimums, quotas, balance)
    assert selection.constrained_selection(table.limit(0), "day", "key", "ordinal", order, limit, CAPS).count() == 0


def test_lane_selection(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["one", "two", "three", None]), rng.choice("abc"), [f"k{rng.randrange(80)}", f"t{rng.randrange(80)}"], rng.choice([1, 2, 3])) for i in range(120)]
    quotas, limit, most, until = {"two": 6, "one": 9}, 20, 4, 0.5
    table = spark.createDataFrame(rows, "ordinal int, lane string, category string, keys array<string>, score int")
    got = selection.lane_selection(table, "lane", quotas, "keys", "category", "ordinal", [(F.col("score"), True), F.col("ordinal")], limit, most, until).collect()
    ranked, out, seen = sorted(rows, key=lambda r: (-r[4], r[0])), [], set()
    for lane, quota in quotas.items():
        for r in ranked:
            if r[1] != lane or seen & set(r[3]) or sum(o[1] == lane for o in out) >= quota:
                continue
            if sum(o[2] == r[2] for o in out) >= most and len(out) < until * limit:
                continue
            out.append(r)
            seen |= set(r[3])
    for r in ranked:
        if len(out) < limit and not seen & set(r[3]):
            out.append(r)
            seen |= set(r[3])
    assert [r.ordinal for r in sorted(got, key=lambda r: r.place)] == [r[0] for r in out]


def test_back_fill(spark):
    short = spark.createDataFrame([("2026-08-02", 2), ("2026-08-01", 2)], "day string, missing int")
    picked = spark.createDataFrame([("2026-08-02", "a", "u"), ("2026-08-01", "a", "u"), ("2026-08-01", "a", "u")], "day string, category string, family string")
    reserve = [
        ("2026-08-03", "k1", 1, "b", "u", 9), ("2026-08-02", "k2", 2, "a", "u", 8), ("2026-08-01", "k3", 3, "b", "v", 7), ("2026-08-01", "k3", 4, "c", "v", 7),
        ("2026-08-01", "k5", 5, "a", "v", 1), ("2026-08-02", "k6", 6, "b", "v", 6),
    ]
    table = spark.createDataFrame(reserve, "day string, key string, ordinal int, category string, family string, score int")
    got = selection.back_fill(short, picked, table, "day", "key", "ordinal", "category", "family", ({}, 2), [(F.col("score"), True), F.col("ordinal")])
    # the later day takes the rarest category, its best row first; a category at its cap gives the earlier day nothing
    assert {(r.day, r.ordinal) for r in got.collect()} == {("2026-08-02", 3), ("2026-08-02", 2)}
    none = selection.back_fill(short.where("missing > 9"), picked, table, "day", "key", "ordinal", "category", "family", ({}, 2), [F.col("ordinal")])
    assert none.count() == 0
