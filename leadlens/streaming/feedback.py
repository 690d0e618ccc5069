"""Feedback events as a stream: acceptance, validity, rate limit, de-duplication and daily counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadlens.functions.values import nz
from leadlens.streaming.changes import clean_action, write_versions

# The actions, and the reasons a pass must give one of.
ACTIONS = ("like", "pass", "clear")
REASONS = ("bad_evidence", "hard_to_execute", "low_margin", "too_ordinary", "weak_function", "wrong_category")


def in_window(created: Column, received: Column, days: int = 30, ahead_minutes: int = 10) -> Column:
    """Whether an event was made within the days before it came in, clocks at most a little ahead."""
    return (created >= received - F.expr(f"interval {days} days")) & (created <= received + F.expr(f"interval {ahead_minutes} minutes"))


def valid(action: Column, reason: Column, actor: Column, product: Column) -> Column:
    """Whether an event meets the constraints: a known action, a reason if and only if it is a pass, names of 1 to 128 characters."""
    act, code = clean_action(action), F.translate(F.lower(F.trim(nz(reason))), "- ", "__")
    named = F.coalesce(F.length(actor).between(1, 128) & F.length(product).between(1, 128), F.lit(False))
    fits = F.when(act == "pass", code.isin(*REASONS)).otherwise(code == "")
    return F.coalesce(act.isin(*ACTIONS) & fits & named, F.lit(False))


def deduplicated(stream: DataFrame, key: str = "event_id", at: str = "received_at", delay: str = "2 days") -> DataFrame:
    """Events without later copies of a key within the delay; works on streams and on tables."""
    if not stream.isStreaming:
        return stream.dropDuplicates([key])
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, at: str = "created_at", delay: str | None = "30 days") -> DataFrame:
    """Counts per day and action; on a stream, events later than the delay are left out (None: the stream has its watermark)."""
    rows = stream.where(F.col(at).isNotNull())
    rows = rows.withWatermark(at, delay) if stream.isStreaming and delay else rows
    return (
        rows.groupBy(F.window(at, "1 day"), clean_action(F.col("action")).alias("action"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("window.start").alias("day"), "action", "n")
    )


def rate_limited(stream: DataFrame, actor: str, at: str, limit: int, seconds: int = 86_400) -> DataFrame:
    """Events within the first ``limit`` of their actor and period, counted as they arrive: keyed state holds one number.

    A null actor or time is in no period and does not pass.
    """
    schema = stream.schema

    def admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for frame in frames:
            yield frame.iloc[: max(0, limit - seen)].drop(columns="_period")
            seen += len(frame)
        state.update((min(seen, limit),))

    keyed = stream.where(F.col(actor).isNotNull() & F.col(at).isNotNull()).withColumn("_period", F.floor(F.unix_timestamp(at) / seconds))
    return keyed.groupBy(actor, "_period").applyInPandasWithState(admit, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def first_seen(stream: DataFrame, key: str, at: str, out: str, checkpoint: str) -> None:
    """Keep the earliest time per key as versions of changed entries; ``first_seen_table`` folds them."""
    write_versions(stream.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias(at)), out, checkpoint)


def first_seen_table(spark: SparkSession, out: str, key: str, at: str) -> DataFrame:
    """The earliest time per key after all versions."""
    return spark.read.parquet(out).groupBy(key).agg(F.min(at).alias(at))


def within_daily_budget(stream: DataFrame, component: str, at: str, calls: int) -> DataFrame:
    """Calls that the budget of their component and day lets through, as they arrive; each day's state is its own, so it begins anew with the day."""
    return rate_limited(stream, component, at, calls)


def fault(action: Column, actor: Column, product: Column, snapshot: Column, largest: int) -> Column:
    """The first constraint that an event breaks: "size" of its snapshot as JSON, "action" or "name"; null for a good one."""
    size = F.length(F.coalesce(F.to_json(snapshot, {"ignoreNullFields": "false"}), F.lit("")))
    named = (F.coalesce(actor, F.lit("")) != "") & (F.coalesce(product, F.lit("")) != "")
    return F.when(size > largest, "size").when(~F.coalesce(F.lower(F.trim(action)).isin(*ACTIONS), F.lit(False)), "action").when(~named, "name")


def run_append(stream: DataFrame, home: str) -> DataFrame:
    """Run a stream that appends to its present end and return all it has written; called again with the same ``home`` it goes on."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{home}/out/run=none")
    query = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{home}/state").foreachBatch(
        lambda batch, n: batch.write.mode("overwrite").parquet(f"{home}/out/run={n}")
    )
    query.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out").select(*stream.columns)


def run_update(stream: DataFrame, home: str, key: list[str]) -> DataFrame:
    """Run a stream of changed rows to its present end and return the latest row of every key."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{home}/out/version=-1")
    write_versions(stream, f"{home}/out", f"{home}/state")
    rows = spark.read.parquet(f"{home}/out")
    whole = F.struct(*[c for c in stream.columns if c not in key])
    return rows.groupBy(*key).agg(F.max_by(whole, "version").alias("_v")).select(*key, "_v.*")
