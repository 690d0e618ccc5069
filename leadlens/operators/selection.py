"""Selections under several caps, and seeded samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens.session import materialise, small_rows


def capped_selection(rows: DataFrame, group: str, caps: dict[str, int], limit: int, order: list[Column], identifier: str) -> DataFrame:
    """Greedy pick per group: rows in order, none beyond the cap of any of its keys, ``limit`` at most; with ``place``.

    A row ranked beyond the smallest cap within its combination of keys can never be picked, so at
    most (combinations x cap) rows of a group reach the one task that runs the counters.
    """
    keys = list(caps)
    combo = Window.partitionBy(group, *keys).orderBy(*order)
    slim = rows.withColumn("_n", F.row_number().over(combo)).where(F.col("_n") <= min(caps.values()))
    slim = slim.withColumn("_o", F.row_number().over(Window.partitionBy(group).orderBy(*order))).select(group, *keys, identifier, "_o")
    names = slim.schema

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[tuple[str, object], int] = {}
        chosen = []
        for row in pdf.sort_values("_o").itertuples(index=False):
            if len(chosen) == limit:
                break
            here = [(k, getattr(row, k)) for k in keys]
            if all(used.get(x, 0) < caps[x[0]] for x in here):
                for x in here:
                    used[x] = used.get(x, 0) + 1
                chosen.append(row)
        out = pd.DataFrame(chosen, columns=pdf.columns)
        return out.assign(_o=range(1, len(out) + 1))

    picked = slim.groupBy(group).applyInPandas(pick, names)
    return picked.withColumnRenamed("_o", "place")


def seeded_sample(rows: DataFrame, identifier: str, n: int, seed: str) -> DataFrame:
    """``n`` rows by hash of seed and identifier: the same rows every time."""
    return rows.orderBy(F.sha1(F.concat(F.lit(seed), F.col(identifier).cast("string"))), identifier).limit(n)


def balanced_sample(rows: DataFrame, group: str, identifier: str, per_group: int, seed: str) -> DataFrame:
    """At most ``per_group`` rows of each group by hash of seed and identifier."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.sha1(F.concat(F.lit(seed), F.col(identifier).cast("string"))), identifier))
    return rows.withColumn("place", place).where(F.col("place") <= per_group)


Cap = tuple[dict[str, int], int]


def _within(counts: dict, row: tuple, caps: dict[str, Cap], at: dict[str, int]) -> bool:
    return all(counts[c].get(row[at[c]], 0) < table.get(row[at[c]], rest) for c, (table, rest) in caps.items())


def constrained_selection(
    rows: DataFrame, group: str, key: str, identifier: str, order: list, limit: int, caps: dict[str, Cap],
    minimums: tuple[str, dict[str, int]] | None = None, quotas: tuple[str, dict[str, int]] | None = None,
    balance: tuple[str, ...] = (), fill_order: list | None = None,
) -> DataFrame:
    """``(group, identifier, step, place)``: a pick per group under caps, by minimums, then quotas, then a balanced fill.

    ``caps`` gives, per column, a table of caps by value and the cap of other values. Rows are tried in ``order``: first each
    value of ``minimums`` in turn until it has its number, then each value of ``quotas`` until the whole pick has its quota of
    it, then the fill, which takes again and again the row whose ``balance`` columns are rarest in the pick so far, compared
    column by column, then the first by ``fill_order``. Rows with a key that the pick has are passed over. ``limit`` is tested
    after a quota's pick and before one of the fill, not in the minimums. Null values are values like others.

    Rows that differ in none of the columns tested compete by order alone, and at most as many as are picked can be passed over for their key: of
    each combination the first ``2 (limit + minimums)`` of either order reach the one task of a group, however many there are.
    """
    tested = list(dict.fromkeys([*caps, *([minimums[0]] if minimums else []), *([quotas[0]] if quotas else []), *balance]))
    bound = 2 * (limit + sum((minimums[1] if minimums else {}).values()))
    fill_order = fill_order or order
    whole = Window.partitionBy(group, *tested)
    ranked = rows.select(group, identifier, key, *[c for c in tested if c not in (group, identifier, key)], *[o.alias(f"_s{i}") for i, o in enumerate(_plain(order))], *[o.alias(f"_t{i}") for i, o in enumerate(_plain(fill_order))])
    sides = [[_directed(o, F.col(f"_{s}{i}")) for i, o in enumerate(by)] for s, by in (("s", order), ("t", fill_order))]
    places = {f"_n{s}": F.row_number().over(whole.orderBy(*side)) for s, side in zip("st", sides)}
    slim = ranked.withColumns(places).where((F.col("_ns") <= bound) | (F.col("_nt") <= bound))
    every = Window.partitionBy(group)
    slim = slim.withColumns({"_first": F.row_number().over(every.orderBy(*sides[0])), "_fill": F.row_number().over(every.orderBy(*sides[1]))})
    columns = [group, identifier, key, *[c for c in tested if c not in (group, identifier, key)], "_first", "_fill"]
    slim = slim.select(*columns)
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {c: i for i, c in enumerate(pdf.columns)}
        table = [tuple(None if x is None or x != x else x for x in r) for r in pdf.sort_values("_first").itertuples(index=False, name=None)]
        counts: dict[str, dict] = {c: {} for c in tested}
        seen, out = set(), []

        def take(row: tuple, step: str) -> None:
            seen.add(row[at[key]])
            out.append((row[at[group]], row[at[identifier]], step, len(out) + 1))
            for c in tested:
                counts[c][row[at[c]]] = counts[c].get(row[at[c]], 0) + 1

        fits = lambda row: row[at[key]] not in seen and _within(counts, row, caps, at)
        if minimums:
            column, wanted = minimums
            for value, n in wanted.items():
                for row in table:
                    if counts[column].get(value, 0) >= n:
                        break
                    if row[at[column]] == value and fits(row):
                        take(row, "minimum")
        if quotas:
            column, wanted = quotas
            for value, n in wanted.items():
                for row in table:
                    if counts[column].get(value, 0) >= n:
                        break
                    if row[at[column]] == value and fits(row):
                        take(row, "quota")
                        if len(out) >= limit:
                            break
                if len(out) >= limit:
                    break
        while len(out) < limit:
            left = [r for r in table if fits(r)]
            if not left:
                break
            take(min(left, key=lambda r: (*(counts[c].get(r[at[c]], 0) for c in balance), r[at["_fill"]])), "fill")
        return pd.DataFrame(out, columns=[group, identifier, "step", "place"])

    return slim.groupBy(group).applyInPandas(pick, f"`{group}` {types[group]}, `{identifier}` {types[identifier]}, step string, place int")


def _plain(order: list) -> list[Column]:
    """The expressions of an order, whose members are columns or, where the largest comes first, ``(column, True)``."""
    return [o[0] if isinstance(o, tuple) else o for o in order]


def _directed(o: Column | tuple, c: Column) -> Column:
    return c.desc_nulls_last() if isinstance(o, tuple) and o[1] else c.asc_nulls_first()


def lane_selection(
    rows: DataFrame, lane: str, quotas: dict[str, int], keys: str, category: str, identifier: str, order: list, limit: int, most: int, until: float
) -> DataFrame:
    """``(identifier, step, place)``: lane by lane its quota in ``order``, then the rest of ``limit`` from all lanes.

    A row that shares any of its ``keys`` (an array) with one picked is passed over; so is, in the lanes, one of a category with ``most``
    picks while fewer than ``until`` of the limit are picked. Each pass walks the sorted rows once and holds the picks only; the
    second reads no row that the first one's picks exclude.
    """
    turn = F.coalesce(*[F.when(F.col(lane) == name, i) for i, name in enumerate(quotas)])
    slim = rows.select(identifier, lane, category, keys, turn.alias("_lane"), *[o.alias(f"_s{i}") for i, o in enumerate(_plain(order))])
    by = [_directed(o, F.col(f"_s{i}")) for i, o in enumerate(order)]
    kind, key_kind = dict(slim.dtypes)[identifier], dict(slim.dtypes)[keys]
    schema = f"`{identifier}` {kind}, `{keys}` {key_kind}, step string, place int"

    def walk(step: str, before: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[str] = set()
            by_lane: dict[str, int] = {}
            by_category: dict[str, int] = {}
            n = before
            for frame in frames:
                out = []
                for i, name, kind_, own in zip(frame[identifier], frame[lane], frame[category], frame[keys]):
                    if n >= limit and step == "fill":
                        break
                    if seen.intersection(own) or (step == "lane" and by_lane.get(name, 0) >= quotas[name]):
                        continue
                    if step == "lane" and by_category.get(kind_, 0) >= most and n < until * limit:
                        continue
                    n += 1
                    seen.update(own)
                    by_lane[name], by_category[kind_] = by_lane.get(name, 0) + 1, by_category.get(kind_, 0) + 1
                    out.append((i, list(own), step, n))
                yield pd.DataFrame(out, columns=[identifier, keys, "step", "place"])

        return run

    first = slim.where("_lane is not null").repartition(1).sortWithinPartitions("_lane", *by).mapInPandas(walk("lane", 0), schema)
    first = materialise(first, "lanes")  # the sum of the quotas at most
    count = first.count()
    taken = first.select(F.explode(keys).alias("_key")).distinct()
    each = slim.select(identifier, F.explode(keys).alias("_key")).join(taken, "_key").select(identifier).distinct()
    rest = slim.join(each, identifier, "left_anti").repartition(1).sortWithinPartitions(*by).mapInPandas(walk("fill", count), schema)
    return first.union(rest).where(F.col("place") <= limit).select(identifier, "step", "place")


def back_fill(
    short: DataFrame, picked: DataFrame, reserve: DataFrame, day: str, key: str, identifier: str, category: str, family: str, cap: Cap, order: list
) -> DataFrame:
    """``(day, identifier)``: rows never picked that fill days up, the latest day first.

    ``short`` holds ``day`` and ``missing``; ``picked`` the day, category and family of each pick. A row of ``reserve`` fits a day that is
    not before its own; of those under the category's cap in the day, the one with the rarest category and family in it comes
    first, then the first in ``order``; it is gone then. Of each day, category and family as many rows as are missing in all reach
    the one task that runs the counters.
    """
    missing = int(short.agg(F.sum("missing")).first()[0] or 0)
    if not missing:
        return reserve.select(day, identifier).where("false")
    slim = reserve.select(day, key, identifier, category, family, *[o.alias(f"_s{i}") for i, o in enumerate(_plain(order))])
    by = [_directed(o, F.col(f"_s{i}")) for i, o in enumerate(order)]
    slim = slim.withColumn("_n", F.row_number().over(Window.partitionBy(day, category, family).orderBy(*by))).where(F.col("_n") <= 2 * missing)
    slim = slim.withColumn("_o", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by)))
    counts = picked.groupBy(day, category, family).agg(F.count(F.lit(1)).alias("_c"))
    need = {r[0]: r[1] for r in small_rows(short.select(day, "missing"), 10_000)}
    before = [tuple(r) for r in small_rows(counts.select(day, category, family, "_c"), 1_000_000)]
    types = dict(slim.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = list(pdf.sort_values("_o")[[day, key, identifier, category, family]].itertuples(index=False, name=None))
        seen, out = set(), []
        for d in sorted(need, reverse=True):
            kinds: dict = {}
            families: dict = {}
            for at, c, f, n in before:
                if at == d:
                    kinds[c], families[f] = kinds.get(c, 0) + n, families.get(f, 0) + n
            for _ in range(need[d]):
                fit = [(kinds.get(r[3], 0), families.get(r[4], 0), i) for i, r in enumerate(table) if r[1] not in seen and r[0] <= d and kinds.get(r[3], 0) < cap[0].get(r[3], cap[1])]
                if not fit:
                    break
                r = table[min(fit)[2]]
                seen.add(r[1])
                kinds[r[3]], families[r[4]] = kinds.get(r[3], 0) + 1, families.get(r[4], 0) + 1
                out.append((d, r[2]))
        return pd.DataFrame(out, columns=[day, identifier])

    return slim.groupBy(F.lit(1).alias("_all")).applyInPandas(run, f"`{day}` {types[day]}, `{identifier}` {types[identifier]}")
