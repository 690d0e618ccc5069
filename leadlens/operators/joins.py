"""Look-ups and merges as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions import url
from leadlens.operators.windows import keep_first


def fresh(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not seen; a null key was never seen."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def listed(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the list."""
    return rows.join(members.select(key).distinct(), key, "left_semi")


def with_default(rows: DataFrame, extra: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Rows with the columns of ``extra`` by key, ``defaults`` where there is none."""
    joined = rows.join(extra.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def by_domain(rows: DataFrame, host: str, domains: DataFrame, domain: str, order: str) -> DataFrame:
    """Rows with the columns of the longest listed domain that their host equals or lies under; one row each, unmatched ones left out.

    An equi-join on the host's suffixes, not a pattern join.
    """
    every = rows.withColumn("_all", url.suffixes(F.col(host))).withColumn("_id", F.monotonically_increasing_id())
    each = every.select("*", F.posexplode("_all").alias("_at", "_suffix"))
    found = each.join(domains, each["_suffix"] == domains[domain])
    return keep_first(found, ["_id"], [F.col("_at"), F.col(order)]).drop("_all", "_id", "_at", "_suffix")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All keys, with the new row where there is one; columns of ``old``."""
    other = new.select(*[F.col(c).alias(f"_n_{c}") for c in old.columns])
    joined = old.join(other, F.col(key) == F.col(f"_n_{key}"), "full")
    return joined.select(*[F.when(F.col(f"_n_{key}").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in old.columns])


def union_keep_first(parts: list[DataFrame], key: list[str], order: list[Column]) -> DataFrame:
    """All parts, one row per key: that of the earliest part, then by ``order``."""
    whole = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("_part", F.lit(i))
        whole = tagged if whole is None else whole.unionByName(tagged, allowMissingColumns=True)
    return keep_first(whole, key, [F.col("_part"), *order]).drop("_part")


def snapshot_merge(previous: DataFrame, current: DataFrame, date: str, key: str, order: Column, target: int) -> DataFrame:
    """Per date the rows of the earlier snapshot, topped up with current ones of other keys to at most ``target``."""
    from leadlens.operators.windows import top_k

    both = union_keep_first([previous.withColumn("_age", F.lit(0)), current.withColumn("_age", F.lit(1))], [date, key], [order])
    return top_k(both, [date], [F.col("_age"), order], target, "_nth").drop("_age", "_nth")


def apply_decisions(products: DataFrame, rejected: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Products, and rejected rows of other keys, with ``state``: kept or rejected as ``decisions.keep`` says, rescued if a rejected row is kept.

    Without a decision a row stays where it is.
    """
    whole = products.withColumn("_new", F.lit(False)).unionByName(fresh(rejected, products, key).select(*products.columns).withColumn("_new", F.lit(True)))
    joined = whole.join(decisions.select(key, "keep"), key, "left")
    kept = F.coalesce("keep", ~F.col("_new"))
    state = F.when(kept & F.col("_new"), "rescued").when(kept, "kept").otherwise("rejected")
    return joined.withColumn("state", state).drop("_new", "keep")
