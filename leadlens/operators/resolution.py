"""Entity resolution: rows that share any key are one entity.

Keys are exploded and components found by alternating large-star and small-star steps, which take
a logarithmic number of rounds on long chains too. Every round is written to the shared folder, so
lineage stays short and a lost executor costs one round. A key held by very many rows costs one
edge per row (to the smallest), not all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.session import let_go, materialise, release


def edges_from_keys(rows: DataFrame, identifier: str, keys: str) -> DataFrame:
    """``(a, b)``: each row with the smallest row of every key it has; null and empty keys join nothing."""
    # written, as keys may be dear to make and are read twice
    each = materialise(rows.select(F.col(identifier).alias("id"), F.explode(keys).alias("key")).where("key <> ''"), "keys")
    least = each.groupBy("key").agg(F.min("id").alias("least"))
    return each.join(least, "key").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of a node go to the smallest of them and the node."""
    if large:
        both = edges.union(edges.select("b", "a")).toDF("node", "near")
        least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least"))
        return both.join(least, "node").where("near > node").select(F.col("near").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near"))
    least = down.groupBy("node").agg(F.min("near").alias("least"))
    found = down.join(least, "node")
    return found.select("near", "least").union(found.select("node", "least")).toDF("a", "b").where("a <> b").distinct()


def components(rows: DataFrame, identifier: str, keys: str, most_rounds: int = 60) -> DataFrame:
    """``(identifier, component)``: the smallest identifier of each row's component; rows without keys are their own."""
    return from_edges(rows.select(identifier), identifier, edges_from_keys(rows, identifier, keys), most_rounds)


def from_edges(rows: DataFrame, identifier: str, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """As ``components``, from edges ``(a, b)`` between identifiers.

    Rounds go on until nothing changes; a graph that is not done after ``most_rounds`` is an error.
    """
    edges, before = materialise(edges, "edges"), None
    for _ in range(most_rounds):
        last, edges = edges, materialise(_star(_star(edges, True), False), "edges")
        release(last)
        let_go(edges.sparkSession)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components do not settle in {most_rounds} rounds")
    labels = edges.groupBy("a").agg(F.min("b").alias("_c"))
    return rows.select(identifier).join(labels, F.col(identifier) == F.col("a"), "left").select(identifier, F.coalesce("_c", F.col(identifier)).alias("component"))
