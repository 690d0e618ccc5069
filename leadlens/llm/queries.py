"""Queries of the training-data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.functions.contributor import with_contributor, with_contributor_of
from leadlens.llm import capping, consensus, history, leakage, lookalike, matching, oracle, sampling, sentences, tokenize
from leadlens.session import materialise, release, small_rows, table
from leadlens.streaming import changes


def owned_leads(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    leads = table(spark, d, "leads").select(*columns)
    return with_contributor(leads, table(spark, d, "source_dim"), table(spark, d, "domain_dim"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Ordinals of leads that the cap takes out."""
    leads = owned_leads(spark, d, "ordinal", "batch_no", "source", "url", "score").select("ordinal", "batch_no", "contributor", "score")
    leads = materialise(leads, "owned")
    return capping.capped(leads, "batch_no", "contributor", "score", "ordinal").where("not kept").select("ordinal")


def titled(leads: DataFrame) -> DataFrame:
    """Leads that have a title or a url."""
    return leads.where("coalesce(trim(title), '') <> '' or coalesce(trim(url), '') <> ''")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of leads whose title or reason looks the same but is another string."""
    leads = titled(table(spark, d, "leads").select("ordinal", "title", "reason", "url"))
    found = lookalike.pairs(leads, "ordinal", ["title", "reason"])
    return found.select("field", F.col("a").alias("ordinal_a"), F.col("b").alias("ordinal_b"))


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    """Title and reason of every lead in their canonical form."""
    leads = table(spark, d, "leads").select("ordinal", "title", "reason")
    return lookalike.unified(leads, "ordinal", ["title", "reason"]).select("field", F.col("id").alias("ordinal"), "canonical")


def fitted(spark: SparkSession, d: str) -> consensus.Consensus:
    votes = changes.standing_votes(table(spark, d, "feedback_events"), "reason")
    return consensus.Consensus(votes, "actor_id", "product_id", "action", "reason")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Products with at least three standing votes that are passed, with the reason."""
    found = fitted(spark, d).items().where("votes >= 3 and verdict = 'pass'")
    return found.select(F.col("item").alias("product_id"), "reason")


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    """Verdict, reason, confidence and agreement of every product."""
    return fitted(spark, d).items().withColumnRenamed("item", "product_id")


def p5_actors(spark: SparkSession, d: str) -> DataFrame:
    """Kind and trust of every actor."""
    return fitted(spark, d).annotators().withColumnRenamed("annotator", "actor_id")


def p2_sampler(spark: SparkSession, d: str) -> sampling.Sampler:
    return sampling.Sampler(table(spark, d, "leads"), table(spark, d, "sample_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the targets that leads cannot fill."""
    return p2_sampler(spark, d).report().where("gap > 0").select("category", "source_type")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Every cell with what it should have, what there is and what stays missing."""
    return p2_sampler(spark, d).report()


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample: ids with the cell each stands for."""
    return p2_sampler(spark, d).sample()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encoded(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold about half or more of an evaluation passage."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "passage")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every document with their places."""
    return sentences.sentences(table(spark, d, "documents"), "doc_id", "text")


def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of all leads, written once."""
    leads = titled(owned_leads(spark, d, "ordinal", "batch_no", "source", "title", "url")).select("ordinal", "batch_no", "contributor", "title", "url")
    domains = {r.domain.lower(): r.source for r in small_rows(table(spark, d, "domain_dim").select("domain", "source").where("domain is not null"))}
    return materialise(history.keyed(leads, "ordinal", "title", "url", "contributor", domains, "batch_no"), "keys")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Leads that repeat an earlier page or post: all batches, fed in order to the growing index."""
    keys = p4_keys(spark, d)
    found = history.replay(spark, keys)
    release(keys)
    return found.select(F.col("id").alias("ordinal"))


def products(spark: SparkSession, d: str) -> DataFrame:
    leads = titled(table(spark, d, "leads").select("ordinal", "id", "source", "category", "title", "reason", "url"))
    sources = materialise(leads.select("source").distinct(), "sources")
    leads = with_contributor_of(leads, sources, table(spark, d, "source_dim"), table(spark, d, "domain_dim"))
    found = matching.clusters(leads.select(F.col("ordinal").alias("row"), "id", F.col("contributor").alias("owner"), "category", "title", "reason", "url"))
    release(sources)
    return found


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of lead ids of different contributors that describe one product."""
    return matching.pairs(materialise(products(spark, d), "products"))


def p7_products(spark: SparkSession, d: str) -> DataFrame:
    """Every lead id with the product it describes."""
    return products(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p2_report": p2_report,
        "p2_sample": p2_sample,
        "p3_found": p3_found,
        "p3_unified": p3_unified,
        "p4_found": p4_found,
        "p5_found": p5_found,
        "p5_items": p5_items,
        "p5_actors": p5_actors,
        "p7_found": p7_found,
        "p7_products": p7_products,
        "p8_ids": p8_ids,
        "p9_found": p9_found,
        "p10_found": p10_found,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; tests compare the others with slow exact forms."""
    return {"p1_found": oracle.P1_FOUND, "p2_found": oracle.P2_FOUND}
