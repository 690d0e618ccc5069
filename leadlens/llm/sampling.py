"""Problem 2: a sample whose shares of category and source type follow given targets.

Method: the wanted counts of the cells are raked by iterative proportional fitting to the category
and the source-type margins of the targets, each cell kept between what it must have and what there
is, so that what one cell lacks goes to others of its row and column. Every id gets an exponential
key weighted by its cell's raked rate; of each cell the smallest keys are drawn, as many as the raked
count says. The gaps that remain are counted in the drawn sample.

Only the table of cells, whose size is that of the fixed targets, is ever in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.functions.unify import loose_key
from leadlens.session import materialise

#: One id of so many is drawn.
ONE_OF = 5
#: Buckets per unit of the logarithm of the keys, by which the draw is cut.
FINE = 4096
#: Rounds of raking; it stops before when no cell moves by a thousandth of an id.
ROUNDS = 500
SEED = "leadlens"
_CELLS = "cell int, category string, source_type string, target_bp int, min_rows int, available bigint, wanted bigint, take bigint, rate double"


def _reachable(goal: np.ndarray, have: np.ndarray) -> np.ndarray:
    whole, full = goal.sum(), np.zeros(len(goal), bool)
    while True:
        free = goal[~full].sum()
        out = np.where(full, have, goal * (max(0.0, whole - have[full].sum()) / free if free > 0 else 0.0))
        more = ~full & (out > have)
        if not more.any():
            return np.minimum(out, have)
        full |= more


def raked(wanted: np.ndarray, least: np.ndarray, have: np.ndarray, axes: list[np.ndarray]) -> np.ndarray:
    """Whole counts between ``least`` and ``have`` whose sums along the axes follow those of ``wanted`` as far as that goes.

    A line that cannot reach its sum gives all it has, and the others take over the rest in proportion.
    """
    goals = [_reachable(np.bincount(a, wanted), np.bincount(a, have)) for a in axes]
    weight = np.where(have > 0, np.maximum(wanted, 1e-9), 0.0)
    weight = np.clip(weight, least, have)
    for _ in range(ROUNDS):
        before = weight
        for axis, goal in zip(axes, goals):
            for _ in range(len(weight)):  # what bounded cells cannot take goes to the free ones of the line
                now = np.bincount(axis, weight, len(goal))
                free = np.where((goal > now)[axis], weight < have, weight > least)
                room = np.bincount(axis, np.where(free, weight, 0.0), len(goal))
                step = np.divide(goal - now + room, room, out=np.ones_like(room), where=room > 0)[axis]
                moved = np.clip(np.where(free, weight * np.maximum(step, 0), weight), least, have)
                if np.abs(moved - weight).max(initial=0) < 1e-9:
                    break
                weight = moved
        if np.abs(weight - before).max(initial=0) < 1e-3:
            break
    out = np.floor(weight + 1e-9).astype(np.int64)
    first, goal = axes[0], goals[0]
    for line in range(len(goal)):  # the rest of each line of the first axis by largest fraction
        missing = int(round(min(goal[line], weight[first == line].sum()))) - int(out[first == line].sum())
        spare = [i for i in np.flatnonzero(first == line) if out[i] < have[i]]
        for i in sorted(spare, key=lambda i: (out[i] - weight[i], i))[: max(0, missing)]:
            out[i] += 1
    return np.clip(out, least, have).astype(np.int64)


def _plan(cells: pd.DataFrame) -> pd.DataFrame:
    """Needs and raked draws of all cells; the row without a cell holds the number of ids."""
    n = int(cells.loc[cells["cell"] < 0, "available"].sum()) // ONE_OF
    out = cells[cells["cell"] >= 0].sort_values("cell").copy()
    bp, have = out["target_bp"].fillna(0).to_numpy(np.int64), out["available"].to_numpy(np.int64)
    out["wanted"] = np.maximum(out["min_rows"].fillna(0).to_numpy(np.int64), -(-bp * n // 10_000))
    wanted = out["wanted"].to_numpy(np.int64)
    axes = [pd.factorize(out[c])[0] for c in ("category", "source_type")]
    # a null spelling is a line of its own
    axes = [np.where(a < 0, a.max(initial=-1) + 1, a) for a in axes]
    out["take"] = raked(wanted.astype(float), np.minimum(wanted, have), have, axes) if len(out) else 0
    out["rate"] = np.divide(out["take"], have, out=np.zeros(len(out)), where=have > 0)
    return out[[c.split()[0] for c in _CELLS.split(", ")]]


class Sampler:
    """Counts and draws distinct ids of ``leads`` for the cells of ``targets``.

    Category and source type are read through their loose spelling. Rows without an id count for
    nothing. An id whose rows lie in several cells counts in each of them, and is drawn for each by
    itself. An empty table gives a report in which all wanted rows are missing, and an empty sample.
    Other columns are not read. The ids are written once, when the object is made.
    """

    def __init__(self, leads: DataFrame, targets: DataFrame):
        keyed = targets.select(
            "category", "source_type", "target_bp", "min_rows", loose_key(F.col("category")).alias("_c"), loose_key(F.col("source_type")).alias("_s")
        )
        # a ring of fixed size: the targets are one small table
        self.targets = keyed.withColumn("cell", (F.row_number().over(Window.orderBy("category", "source_type")) - 1).cast("int"))
        rows = leads.select("id", loose_key(F.col("category")).alias("_c"), loose_key(F.col("source_type")).alias("_s"))
        rows = rows.where("id is not null and _c is not null and _s is not null").distinct()
        placed = rows.join(self.targets.select("_c", "_s", "cell"), ["_c", "_s"], "left")
        ids = placed.groupBy("id").agg(F.collect_set("cell").alias("cells"))
        #: (id, cell): every cell of every id, and the cell -1 once for every id.
        self.members = materialise(ids.select("id", F.explode(F.concat("cells", F.array(F.lit(-1)))).alias("cell")), "members")
        self.cells = materialise(self._cells(), "cells")

    def _cells(self) -> DataFrame:
        counts = self.members.groupBy("cell").agg(F.count(F.lit(1)).alias("available"))
        whole = (
            self.targets.join(counts, "cell", "full")
            .select("cell", "category", "source_type", "target_bp", "min_rows", F.coalesce("available", F.lit(0)).alias("available"))
        )
        return whole.groupBy(F.lit(0).alias("_all")).applyInPandas(_plan, _CELLS)

    def drawn(self) -> DataFrame:
        """``(id, cell)``: of each cell the ids of its smallest keys."""
        unit = (F.pmod(F.xxhash64(F.lit(SEED), F.col("id")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        keyed = (
            self.members.join(self.cells.where("take > 0").select("cell", "take", "rate"), "cell")
            .withColumn("key", -F.log(unit) / F.col("rate"))
            .withColumn("bucket", F.floor(F.log(F.col("key")) * FINE))
        )
        # counts per bucket, whose number does not grow with the ids, show where each cell is cut
        counts = keyed.groupBy("cell", "bucket").agg(F.count(F.lit(1)).alias("n"), F.first("take").alias("take"))
        before = F.sum("n").over(Window.partitionBy("cell").orderBy("bucket")) - F.col("n")
        rooms = counts.withColumn("room", F.col("take") - before).where("room > 0").select("cell", "bucket", "room", "n")
        open_ = keyed.select("id", "cell", "bucket", "key").join(rooms, ["cell", "bucket"])
        at = F.row_number().over(Window.partitionBy("cell", "bucket").orderBy("key", "id"))
        cut = open_.where("room < n").withColumn("at", at).where("at <= room")
        return open_.where("room >= n").select("id", "cell").unionByName(cut.select("id", "cell"))

    def sample(self) -> DataFrame:
        """``(id, category, source_type)`` of the drawn ids; the same ids give the same sample."""
        return self.drawn().join(self.cells, "cell").select("id", "category", "source_type")

    def report(self) -> DataFrame:
        """One row per cell; ``gap`` is what the drawn sample misses of ``wanted``."""
        counts = self.drawn().groupBy("cell").agg(F.count(F.lit(1)).alias("drawn"))
        found = self.cells.join(counts, "cell", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        gap = F.greatest(F.lit(0), F.col("wanted") - F.col("drawn"))
        return found.select("category", "source_type", "target_bp", "min_rows", "wanted", "available", "drawn", gap.cast("long").alias("gap"))
