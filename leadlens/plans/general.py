"""Queries of the general training-data problem (6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadlens.streaming import changes


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Votes standing after the whole feed was applied as a stream."""
    return changes.replay(spark, f"{d}/feedback_events.parquet").select("actor_id", "product_id", "event_id")


P6_SQL = r"""
with changes as (
  select event_id, actor_id, product_id, lower(regexp_replace(action, '^[\s\p{Z}\p{Cc}\p{Cf}]+|[\s\p{Z}\p{Cc}\p{Cf}]+$', '', 'g')) as action, created_at, received_at
  from feedback_events
  where event_id <> '' and actor_id <> '' and product_id <> ''
), ours as (select * from changes where action in ('like', 'pass', 'clear')),
latest as (
  select *, row_number() over (partition by event_id order by received_at desc nulls last, created_at desc nulls last, actor_id desc, product_id desc, action desc) as n from ours
), ranked as (
  select *, row_number() over (partition by actor_id, product_id order by coalesce(created_at, received_at) desc nulls last, received_at desc nulls last, event_id desc) as k
  from latest where n = 1
)
select actor_id, product_id, event_id from ranked where k = 1 and action <> 'clear'
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p6_found": p6_found}


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_SQL}
