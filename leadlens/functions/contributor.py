"""Which contributor a lead belongs to: its source by spelling or domain, else the host of its url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions.unify import loose_key, same_look_mostly_ascii

#: Loose keys of values that mean "no source given".
NO_SOURCE = ("unknown",)


def host_of(url: Column) -> Column:
    """Lower-case host of a url without user, port, trailing dot and leading ``www.``; null if there is none."""
    host = F.regexp_extract(F.trim(same_look_mostly_ascii(url)), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^(?:www\.)+|\.+$", ""), F.lit(""))


def domain_key(c: Column) -> Column:
    """Key of a domain, with or without scheme, path or ``www.``."""
    bare = F.lower(F.trim(same_look_mostly_ascii(c)))
    bare = F.regexp_replace(bare, r"^[a-z][a-z0-9+.\-]*://", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"[/?#:].*$", ""), r"^(?:www\.)+|\.+$", ""), F.lit(""))


def name_map(source_dim: DataFrame, domain_dim: DataFrame) -> DataFrame:
    """``(_k, _contributor)``: every loose key and every domain that names a contributor, one row a key.

    Both dimensions are small fixed tables; the planner broadcasts the result by its size, else shuffles.
    """
    names = source_dim.select(loose_key(F.col("source")).alias("_k"), F.col("source").alias("_contributor"), F.lit(0).alias("_o"))
    domains = domain_dim.select(
        F.concat(F.lit("@"), domain_key(F.col("domain"))).alias("_k"),
        F.col("source").alias("_contributor"),
        F.coalesce(F.col("ord"), F.lit(0)).alias("_o"),
    )
    both = names.unionByName(domains).where("_k is not null and _contributor is not null")
    return both.groupBy("_k").agg(F.min(F.struct("_o", "_contributor"))["_contributor"].alias("_contributor"))


def with_contributor(leads: DataFrame, source_dim: DataFrame, domain_dim: DataFrame, out: str = "contributor") -> DataFrame:
    """``leads`` with column ``out``: the contributor's name as in ``source_dim``, null if there is none.

    A source that is given but means no known contributor gives null; only where it is missing,
    empty or "unknown" does the host of ``url`` count. Rows keep their number, and their other
    columns whatever these are called; a column ``out`` is replaced.
    """
    keyed = leads.select(F.struct(*[F.col(f"`{c}`") for c in leads.columns if c != out]).alias("_all"), "source", "url")
    keyed = keyed.withColumns({
        "_cs": loose_key(F.col("source")), "_ch": F.concat(F.lit("@"), host_of(F.col("url"))), "_cd": F.concat(F.lit("@"), domain_key(F.col("source"))),
    }).withColumn("_missing", F.col("_cs").isNull() | F.col("_cs").isin(*NO_SOURCE))
    keyed = keyed.select(
        "_all", F.when(F.col("_missing"), F.col("_ch")).otherwise(F.col("_cs")).alias("_ck"), F.when(~F.col("_missing"), F.col("_cd")).alias("_cd")
    )
    names = name_map(source_dim, domain_dim)
    by_key = names.withColumnsRenamed({"_k": "_ck", "_contributor": "_by_key"})
    by_domain = names.withColumnsRenamed({"_k": "_cd", "_contributor": "_by_domain"})
    return keyed.join(by_key, "_ck", "left").join(by_domain, "_cd", "left").select("_all.*", F.coalesce("_by_key", "_by_domain").alias(out))


def with_contributor_of(leads: DataFrame, sources: DataFrame, source_dim: DataFrame, domain_dim: DataFrame, out: str = "contributor") -> DataFrame:
    """``with_contributor`` for leads with few spellings of sources: ``sources`` has each of them once in its column ``source``.

    Every spelling is looked up once instead of once a row, which pays if ``sources`` is written first, so that the planner
    knows its size. Leads need no column of a name with a leading underscore.
    """
    names = name_map(source_dim, domain_dim)
    keyed = sources.select(
        F.col("source").alias("_source"), loose_key(F.col("source")).alias("_cs"), F.concat(F.lit("@"), domain_key(F.col("source"))).alias("_cd")
    ).withColumn("_missing", F.col("_cs").isNull() | F.col("_cs").isin(*NO_SOURCE))
    by_key = keyed.join(names.withColumnsRenamed({"_k": "_cs", "_contributor": "_by_key"}), "_cs", "left")
    told = by_key.join(names.withColumnsRenamed({"_k": "_cd", "_contributor": "_by_domain"}), "_cd", "left")
    told = told.select("_source", "_missing", F.when(~F.col("_missing"), F.coalesce("_by_key", "_by_domain")).alias("_told"))
    found = leads.join(told, F.col("source").eqNullSafe(F.col("_source")), "left")
    found = found.withColumn("_ch", F.when(F.col("_missing"), F.concat(F.lit("@"), host_of(F.col("url")))))
    found = found.join(names.withColumnsRenamed({"_k": "_ch", "_contributor": "_by_host"}), "_ch", "left")
    return found.select(*[F.col(f"`{c}`") for c in leads.columns if c != out], F.coalesce("_told", "_by_host").alias(out))
