"""Pairs of texts that can be near each other, tried tile by tile on counts of characters.

Two texts of la and lb characters of which blocks of m in all match have a gestalt ratio of 2 m / (la + lb); the
blocks are one common subsequence, so a ratio of 0.9 leaves at most (la + lb) / 10 characters outside one. No more can
the counts of their characters differ, and no key of a few characters is certain to be shared by two such texts and
rare. So all pairs of fitting lengths are tried, at one exclusive or and one count of bits each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks are laid into so many buckets, the blank one into another, and lengths from LONGEST on count as one: the driver sees a table of fixed size.
BUCKETS, LONGEST = 1024, 255
#: Texts of a tile, pairs tried at once and pairs looked at closely at once.
TILE, AT_ONCE, CLOSELY = 65_536, 131_072, 16_384
#: Pairs of texts tried in one task.
TASK = 1 << 30
#: Kinds of characters that are counted, and how many of a kind are told apart in the bits.
KINDS, MOST = 64, 12
#: Texts above that length are not compared as subsequences, as their bits would fill too many numbers.
SUBSEQUENCE = 512

_ASCII = np.array([i - 97 if 97 <= i < 123 else i - 22 if 48 <= i < 58 else 36 if i == 32 else 37 + i % 27 for i in range(128)], dtype="uint8")


class _Tiles:
    """Which tile a text of a bucket and length is in, and the run of tiles that each tile is held against."""

    def __init__(self) -> None:
        self.shortest, self.longest = np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")
        self.low, self.high, self.held = np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")

    def lay(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, slice]:
        """First tile and number of tiles for each length, and the new tiles: runs of lengths, or parts of a length that very many texts have."""
        first, parts, began = np.zeros(len(counts), dtype="int64"), np.ones(len(counts), dtype="int64"), len(self.low)
        total = int(counts.sum())
        target = -(-total // max(1, -(-total // TILE)))
        shortest, longest, sizes = [], [], []
        for length in np.flatnonzero(counts):
            n = int(counts[length])
            parts[length] = -(-n // target)
            if sizes and parts[length] == 1 and sizes[-1] + n <= target and parts[longest[-1]] == 1:
                first[length], sizes[-1], longest[-1] = began + len(shortest) - 1, sizes[-1] + n, length
                continue
            first[length] = began + len(shortest)
            sizes += [-(-n // int(parts[length]))] * int(parts[length])
            shortest += [length] * int(parts[length])
            longest += [length] * int(parts[length])
        self.shortest = np.concatenate([self.shortest, np.array(shortest, dtype="int64")])
        self.longest = np.concatenate([self.longest, np.where(np.array(longest, dtype="int64") == LONGEST, 1 << 40, np.array(longest, dtype="int64"))])
        self.low, self.high = (np.concatenate([x, np.full(len(shortest), fill)]) for x, fill in ((self.low, 0), (self.high, -1)))
        self.held = np.concatenate([self.held, np.array(sizes, dtype="int64")])
        return first, parts, slice(began, began + len(shortest))

    def hold(self, some: slice, others: slice) -> None:
        """Each of some tiles is held against those of the others whose lengths fit: 9/11 or more of one another."""
        self.low[some] = others.start + np.searchsorted(11 * self.longest[others], 9 * self.shortest[some])
        self.high[some] = others.start + np.searchsorted(9 * self.shortest[others], 11 * self.longest[some], "right") - 1


def _spread(counts: np.ndarray) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], int, int]:
    """What gives a text to each pair of tiles that needs it, inside its bucket and where blank ones meet the others; the first tile of the latter; how many pairs of texts there are."""
    tiles = _Tiles()
    first, parts = np.zeros((BUCKETS + 3, LONGEST + 1), dtype="int64"), np.ones((BUCKETS + 3, LONGEST + 1), dtype="int64")
    for k in np.flatnonzero(counts.sum(axis=1)):
        first[k], parts[k], own = tiles.lay(counts[k])
        tiles.hold(own, own)
    across = len(tiles.low)
    first[BUCKETS + 1], parts[BUCKETS + 1], given = tiles.lay(counts[:BUCKETS].sum(axis=0))
    first[BUCKETS + 2], parts[BUCKETS + 2], blank = tiles.lay(counts[BUCKETS])
    tiles.hold(given, blank)
    tiles.hold(blank, given)
    low, high = tiles.low, tiles.high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, length, part = (batch.column(c).to_numpy().astype("int64") for c in ("bucket", "length", "part"))
            for kind in (bucket, np.where(bucket < BUCKETS, BUCKETS + 1, BUCKETS + 2)):
                tile = first[kind, length] + part % parts[kind, length]
                n = np.maximum(high[tile] - low[tile] + 1, 0) if len(low) else np.zeros(len(tile), dtype="int64")
                for least in range(0, int(n.max(initial=0)), 64):  # so many copies of a batch at most are made at once
                    some = np.clip(n - least, 0, 64)
                    row = np.repeat(np.arange(len(tile)), some)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some) + least + low[tile[row]]
                    made = {"x": pa.array(np.minimum(tile[row], other)), "y": pa.array(np.maximum(tile[row], other)), "tile": pa.array(tile[row])}
                    made |= {c: batch.column(c).take(pa.array(row)) for c in ("id", "space", "w")}
                    yield pa.RecordBatch.from_pydict(made)

    upto = np.concatenate([[0], np.cumsum(tiles.held)])
    work = int((tiles.held * np.where(high >= low, upto[high + 1] - upto[low], 0)).sum())
    return run, across, work


class _Texts:
    """Texts of one or two tiles in order of length, their characters by kind, counts and bits."""

    def __init__(self, table: pa.Table) -> None:
        words = table.column("w").to_pylist()
        n = np.array([len(w) for w in words], dtype="int64")
        order = np.argsort(n, kind="stable")
        words, self.n, self.table = [words[i] for i in order], n[order], table.take(pa.array(order))
        self.space, self.tile = (self.table.column(c).to_numpy() for c in ("space", "tile"))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="uint32")
        self.kinds = np.where(codes < 128, _ASCII[codes & 127], 37 + (codes * np.uint32(2654435761) >> 12) % 27).astype("uint8")
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.counts = np.zeros((len(words), KINDS), dtype="uint8")
        for i in range(0, len(words), 8192):
            j = min(i + 8192, len(words))
            row = np.repeat(np.arange(j - i), self.n[i:j])
            found = np.bincount(row * KINDS + self.kinds[self.start[i] : self.start[j]], minlength=(j - i) * KINDS)
            self.counts[i:j] = np.minimum(found, 255).reshape(j - i, KINDS)
        # of all 'at least k of a kind' those that tell most texts apart: two texts differ in no more bits than in counts
        share = np.stack([(self.counts >= k).mean(axis=0) for k in range(1, MOST + 1)])
        best = np.argsort(-(share * (1 - share)).ravel(), kind="stable")[:128]
        self.bits = np.zeros((2, len(words)), dtype="uint64")
        for place, one in enumerate(best):
            self.bits[place // 64] |= (self.counts[:, one % KINDS] >= one // KINDS + 1).astype("uint64") << np.uint64(place % 64)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of kinds, for pairs of texts; a number of 64 bits has 64 characters of the first."""
        numbers, place = -(-int(self.n[x].max()) // 64), np.arange(len(x))
        at = np.zeros((numbers, KINDS + 1, len(x)), dtype="uint64")
        for i in range(int(self.n[x].max())):
            p = place[self.n[x] > i]
            at[i // 64, self.kinds[self.start[x[p]] + i], p] |= np.uint64(1 << i % 64)
        left = np.full((numbers, len(x)), ~np.uint64(0))
        for j in range(int(self.n[y].max())):
            there = self.n[y] > j
            kind = np.where(there, self.kinds[np.minimum(self.start[y] + j, len(self.kinds) - 1)], KINDS)
            carry = np.zeros(len(x), dtype="uint64")
            for k in range(numbers):
                v = left[k]
                met = v & at[k, kind, place]
                half = v + met
                total = half + carry
                carry = ((half < v) | (total < half)).astype("uint64")
                left[k] = total | (v & ~met)
        return np.bitwise_count(~left).sum(axis=0, dtype="int64")

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs have at most a tenth of their characters outside the counts and the subsequence they share."""
        most = (self.n[x] + self.n[y]) // 10
        ok = np.abs(self.counts[x].astype("int16") - self.counts[y]).sum(axis=1) <= most
        some = np.flatnonzero(ok & (self.n[x] <= SUBSEQUENCE) & (self.n[y] <= SUBSEQUENCE))
        for i in range(0, len(some), CLOSELY):
            p = some[i : i + CLOSELY]
            ok[p] = self.n[x[p]] + self.n[y[p]] - 2 * self.common(x[p], y[p]) <= most[p]
        return ok

    def tried(self, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs whose bits differ in a tenth of the characters at most; with ``same`` left and right are one list."""
        nx, ny = self.n[left], self.n[right]
        bx, by = self.bits[0][left], self.bits[0][right]
        apart, bits, ok = (np.empty(max(AT_ONCE, len(right)), dtype=t) for t in ("uint64", "uint8", "bool"))
        ends = np.flatnonzero(np.diff(nx, append=-1)) + 1
        for i, j in zip(np.concatenate([[0], ends[:-1]]), ends):
            n = int(nx[i])
            low, high = (n if same else -(-9 * n // 11)), 11 * n // 9
            while low <= high:
                most = (n + low) // 10
                last = min(high, 10 * most + 9 - n)  # as long as as many may differ
                p, q = np.searchsorted(ny, [low, last + 1])
                low = last + 1
                step = max(1, AT_ONCE // max(1, q - p))
                for s in range(i, j if p < q else i, step):
                    e, f = min(s + step, j), (max(p, s) if same else p)
                    if f >= q:
                        break
                    size = (e - s) * (q - f)
                    a, b, c = (z[:size].reshape(e - s, q - f) for z in (apart, bits, ok))
                    np.bitwise_xor(bx[s:e, None], by[None, f:q], out=a)
                    np.bitwise_count(a, out=b)
                    np.less_equal(b, most, out=c)
                    found = np.flatnonzero(ok[:size])
                    x, y = left[s + found // (q - f)], right[f + found % (q - f)]
                    if same:
                        x, y = x[x < y], y[x < y]
                    rest = np.bitwise_count(self.bits[0][x] ^ self.bits[0][y]) + np.bitwise_count(self.bits[1][x] ^ self.bits[1][y])
                    yield x[rest <= most], y[rest <= most]


def _pairs(across: int) -> Callable[[pa.Table], pa.Table]:
    """``(x, y, wx, wy)`` of the pairs between two tiles, or inside one, that are near by counts and subsequence."""

    def run(table: pa.Table) -> pa.Table:
        one, two = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        texts, parts, waiting, held = _Texts(table), [], [], 0

        def look() -> None:
            x, y = (np.concatenate(z) for z in zip(*waiting))
            near = texts.near(x, y)
            parts.append((x[near], y[near]))
            waiting.clear()

        for x, y in texts.tried(np.flatnonzero(texts.tile == one), np.flatnonzero(texts.tile == two), one == two):
            if two < across:  # tiles of one bucket, which several blocks may be in
                same = texts.space[x] == texts.space[y]
                x, y = x[same], y[same]
            waiting.append((x, y))
            held += len(x)
            if held >= CLOSELY or len(waiting) >= 4096:
                look()
                held = 0
        if waiting:
            look()
        x, y = (pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype="int64")) for k in (0, 1))
        ids, words = (texts.table.column(c).combine_chunks() for c in ("id", "w"))
        return pa.table({"x": ids.take(x), "y": ids.take(y), "wx": words.take(x), "wy": words.take(y)})

    return run


def close_texts(texts: DataFrame) -> DataFrame:
    """``(a, b, wa, wb)``, ``a < b``: all pairs of ``texts``, of columns id, block and w, with a tenth of their characters apart at most.

    Pairs are of one block, or one of the two is in the block ``''``. Every pair of gestalt ratio 0.9 or more is there, once.
    ``texts`` is read twice; no text may be empty.
    """
    length = F.least(F.length("w"), F.lit(LONGEST)).alias("length")
    bucket = F.when(F.col("block") == "", BUCKETS).otherwise(F.pmod(F.xxhash64("block"), F.lit(BUCKETS))).cast("int").alias("bucket")
    rows = texts.select("id", F.xxhash64("block").alias("space"), bucket, length, F.pmod(F.xxhash64("id"), F.lit(1 << 31)).alias("part"), "w")
    found = rows.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros((BUCKETS + 1, LONGEST + 1), dtype="int64")
    counts[found.column("bucket").to_numpy(), found.column("length").to_numpy()] = found.column("n").to_numpy()
    spread, across, work = _spread(counts)
    longs = [T.StructField(c, T.LongType()) for c in ("x", "y", "tile")]
    given = rows.mapInArrow(spread, T.StructType([*longs, *(rows.schema[c] for c in ("id", "space", "w"))]))
    kind = texts.schema["id"].dataType
    out = T.StructType([T.StructField("x", kind), T.StructField("y", kind), T.StructField("wx", T.StringType()), T.StructField("wy", T.StringType())])
    # a pair of tiles is much work and few bytes, so that tasks are parted by the pairs tried and not by size
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, min(work // TASK, 4096))
    tried = given.repartition(tasks, "x", "y").groupBy("x", "y").applyInArrow(_pairs(across), out)
    first = F.col("x") < F.col("y")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return tried.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("wx", "wy").alias("wa"), pick("wy", "wx").alias("wb"))
