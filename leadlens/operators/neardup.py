"""Near-duplicates by Jaccard similarity of token sets within a block.

Rows with equal token sets are one class; only class representatives are compared. Prefix filtering
gives the candidates: two sets of the wanted similarity share a token among the rarest few of each, and
where many sets have that token, the next one too.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.functions.similarity import gestalt, jaccard
from leadlens.operators.closeness import close_texts
from leadlens.session import let_go, materialise, release


def classes(rows: DataFrame, identifier: str, block: str, tokens: Column) -> DataFrame:
    """``(identifier, block, tokens, rep)``: the smallest identifier with the same block and token set."""
    keyed = rows.select(identifier, block, F.array_sort(F.array_distinct(tokens)).alias("tokens"))
    reps = keyed.groupBy(block, "tokens").agg(F.min(identifier).alias("rep"))
    return keyed.join(reps, [block, "tokens"])


def _representatives(rows: DataFrame, identifier: str, block: str, tokens: Column, least: int) -> DataFrame:
    """``(id, block, tokens)`` of what ``classes`` calls ``rep``, of sets of at least ``least`` tokens."""
    keyed = rows.select(identifier, block, F.array_sort(F.array_distinct(tokens)).alias("tokens")).where(F.size("tokens") >= least)
    return keyed.groupBy(block, "tokens").agg(F.min(identifier).alias("id")).select("id", block, "tokens")


def jaccard_pairs(rows: DataFrame, identifier: str, block: str, tokens: Column, threshold: float, least: int = 2) -> DataFrame:
    """``(a, b, similarity)`` between class representatives of one block, ``a < b``; sets under ``least`` tokens take no part."""
    return _similar(_representatives(rows, identifier, block, tokens, least), block, threshold)


def jaccard_texts(rows: DataFrame, identifier: str, block: str, tokens: Column, threshold: float) -> DataFrame:
    """As ``jaccard_pairs``, between all rows: texts that differ though their token sets are equal are pairs too."""
    return _similar(rows.select(F.col(identifier).alias("id"), block, F.array_distinct(tokens).alias("tokens")).where("size(tokens) > 0"), block, threshold)


def _similar(sets: DataFrame, block: str, threshold: float) -> DataFrame:
    sets = sets.where(F.col(block).isNotNull())
    return _verified(materialise(sets.select("id", F.xxhash64(block).alias("space"), F.lit(True).alias("counted"), "tokens"), "sets"), threshold, False)


def blank_pairs(rows: DataFrame, identifier: str, block: str, tokens: Column, threshold: float, least: int = 2) -> DataFrame:
    """As ``jaccard_pairs``, between representatives of which one or both have a null or empty block: a blank block goes with any."""
    rows = rows.withColumn(block, F.coalesce(block, F.lit("")))
    sets = _representatives(rows, identifier, block, tokens, least)
    return _verified(materialise(sets.select("id", F.lit(0).cast("long").alias("space"), (F.col(block) == "").alias("counted"), "tokens"), "sets"), threshold, True)


#: Numbers that tokens are counted under, so that the driver sees a table of fixed size.
BUCKETS = 1 << 20
#: A key that more counted sets have is lengthened by one more token.
COMMON = 128


def _in_order(counts: np.ndarray, lone: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts tokens into one order, rarest first, without those of which a bucket has ``lone`` or less; ``rare``: how many are not common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("hashes")
            h = held.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
            n = counts[h & (BUCKETS - 1)]
            h, row, n = (x[n > lone] for x in (h, row, n))
            order = np.lexsort((h, n, row))
            h, n = h[order], n[order]
            ends = np.cumsum(np.bincount(row, minlength=len(held)))
            marks = np.zeros(len(held), dtype="int64")
            np.bitwise_or.at(marks, row, np.int64(1) << ((h >> 20) & 63).astype("int64"))
            made = {c: batch.column(c) for c in ("id", "size", "counted")}
            made |= {"marks": pa.array(marks), "rare": pa.array(np.bincount(row[n <= COMMON], minlength=len(held)).astype("int32"))}
            made["tokens"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), pa.array(h))
            yield pa.RecordBatch.from_pydict(made)

    return run


def _candidates(sets: DataFrame, threshold: float, some: bool) -> DataFrame:
    """``(a, b)`` with all pairs of sets of one space that can have the similarity; with ``some`` at least one of the two is counted.

    A set of n tokens shares at least m = ceil(n * threshold) with a similar one. Let two such sets share
    w1, w2, ... in one order of all tokens: w1 is among the first n - m + 1 of each, w2 among the first
    n - m + 2, and so on. The key w1 is made longer, w1 w2, where many sets have it, and so on until no key
    is common; whether it is depends on the key alone, so that both sets have it in the same length. Where
    a set need not share more than the key has, it keeps its common key too, for its like.
    """
    hashes = F.expr("transform(tokens, t -> hash(space, t))")
    rows = sets.select("id", "counted", F.size("tokens").alias("size"), hashes.alias("hashes"))
    used = rows.where("counted").select(F.explode("hashes").alias("h")).groupBy((F.col("h").bitwiseAND(F.lit(BUCKETS - 1))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    found = used.toArrow()
    counts = np.zeros(BUCKETS, dtype="int64")
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    kind = T.StructType([*(rows.schema[c] for c in ("id", "size", "counted")), T.StructField("marks", T.LongType()), T.StructField("rare", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    ordered = rows.mapInArrow(_in_order(counts, 0 if some else 1), kind)
    ordered = ordered.withColumns({"need": F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)).cast("int"), "n": F.size("tokens")}).where("n >= need")
    ordered = ordered.withColumn("lone", F.col("size") - F.col("n"))
    own = ["id", "counted", "size", "lone", "need", "n", "marks"]
    single = "transform(slice(tokens, 1, least(rare, n - need + 1)), t -> struct(cast(t as long) as key, true as done, cast(null as array<int>) as rest))"
    ended = "if(need <= {d}, array(struct(xxhash64({key}, 'end') as key, true as done, cast(null as array<int>) as rest)), array())"
    longer = "transform(sequence({i} + 1, {last}), j -> struct(xxhash64({key}, {tokens}[j - 1]) as key, false as done, slice({tokens}, j + 1, greatest(size({tokens}) - j, 0)) as rest))"
    second = longer.format(i="i", key="cast(tokens[i - 1] as long)", last="least(n, n - greatest(need, 2) + 2)", tokens="tokens")
    second = f"concat({ended.format(d=1, key='cast(tokens[i - 1] as long)')}, if(i < least(n, n - greatest(need, 2) + 2), {second}, array()))"
    keyed = f"concat({single}, if(rare < n - need + 1, flatten(transform(sequence(rare + 1, n - need + 1), i -> {second})), array()))"
    made = ordered.select(*own, F.expr(f"inline({keyed})"))
    parts, written, depth = [], [], 2
    while True:
        group = Window.partitionBy("key", "done")
        made = made.withColumns({"held": F.count(F.lit(1)).over(group), "with": F.count(F.when(F.col("counted"), 1)).over(group)})
        made = materialise(made.where("held > 1 and with > 0").withColumn("done", F.col("done") | (F.col("with") <= COMMON)).drop("held", "with"), "keys")
        let_go(made.sparkSession)
        written.append(made)
        parts.append(made.where("done").drop("rest", "done", "need", "n"))
        if made.where("not done").isEmpty():
            break
        # of the tokens that follow, the one in place j of rest is in place n - size(rest) + j of the set
        last = f"least(size(rest), size(rest) - greatest(need, {depth + 1}) + {depth + 1})"
        step = longer.format(i="0", key="key", last=last, tokens="rest")
        made = made.where("not done").select(*own, F.expr(f"inline(concat({ended.format(d=depth, key='key')}, if({last} > 0, {step}, array())))"))
        depth += 1
    heads = functools.reduce(DataFrame.union, parts)
    x, y = (heads.select("key", *[F.col(c).alias(f"_{c}{s}") for c in ("id", "counted", "size", "lone", "marks")]) for s in "xy")
    # tokens of one set only are at most this share of both sizes
    apart = f"(bit_count(_marksx ^ _marksy) + _lonex + _loney) * {1 + threshold!r}D <= (_sizex + _sizey) * {1 - threshold!r}D + 1e-6"
    pairs = x.where("_countedx").join(y, "key").where(f"(_idx < _idy or not _countedy) and {apart}")
    found = materialise(pairs.select(F.least("_idx", "_idy").alias("a"), F.greatest("_idx", "_idy").alias("b")).distinct(), "candidates")
    release(*written)
    let_go(found.sparkSession)
    return found


def _verified(sets: DataFrame, threshold: float, some: bool) -> DataFrame:
    candidates = _candidates(sets, threshold, some)
    left, right = sets.select(F.col("id").alias("a"), F.col("tokens").alias("_ta")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("_tb"))
    scored = candidates.join(left, "a").join(right, "b").withColumn("similarity", jaccard(F.col("_ta"), F.col("_tb")))
    return scored.where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def gestalt_pairs(candidates: DataFrame, a: str, b: str, threshold: float, lengths: float = 0.72, least: int = 8) -> DataFrame:
    """Candidate pairs whose texts match by gestalt ratio; the cheap length filters run before the Python function."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    near = candidates.where((short >= least) & (short >= lengths * long))
    return near.withColumn("ratio", gestalt(F.col(a), F.col(b))).where(F.col("ratio") >= threshold)


def gestalt_matches(rows: DataFrame, identifier: str, block: str, words: str, lengths: float = 0.72, least: int = 8) -> DataFrame:
    """``(a, b, ratio)`` of all pairs of texts of one block with a gestalt ratio of 0.9 or more, ``a < b``; a null or empty block goes with any.

    Equal texts of a block enter once, by their smallest identifier. No pair is lost to the candidates, see ``closeness``.
    """
    texts = rows.select(identifier, F.coalesce(block, F.lit("")).alias("block"), F.col(words).alias("w")).where(F.length("w") >= max(least, 1))
    texts = materialise(texts.groupBy("block", "w").agg(F.min(identifier).alias("id")).select("id", "block", "w"), "texts")
    return gestalt_pairs(close_texts(texts), "wa", "wb", 0.9, lengths, least).select("a", "b", "ratio")
