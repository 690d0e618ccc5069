"""Queries that run a table's files as a stream to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.plans.registry import query
from leadlens.session import is_file, materialise, scratch, table
from leadlens.streaming import feedback


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder, file = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder) if is_file(spark, path) else spark.readStream.schema(schema).parquet(path)


@query("stream_deduplicated", "select distinct event_id from feedback_events where event_id <> '' and received_at is not null")
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Event ids of the feed, each once: later copies within the delay are dropped by keyed state."""
    rows = stream_of(spark, d, "feedback_events").where("event_id <> '' and received_at is not null").select("event_id", "received_at")
    return feedback.run_append(feedback.deduplicated(rows), scratch(spark, "stream")).select("event_id")


@query("stream_daily_counts", "select cast(created_at as date) as day, lower(trim(action)) as action, count(*) as n from feedback_events where created_at is not null group by 1, 2")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per day and action, kept by the stream and folded from its versions."""
    counts = feedback.daily_counts(stream_of(spark, d, "feedback_events"))
    return feedback.run_update(counts, scratch(spark, "stream"), ["day", "action"])


@query(
    "stream_rate_guard",
    "select actor_id, cast(floor(epoch(received_at) / 86400) as bigint) as period, least(count(*), 200) as n from feedback_events where actor_id <> '' and received_at is not null group by 1, 2",
)
def stream_rate_guard(spark: SparkSession, d: str) -> DataFrame:
    """Events per actor and day that pass a limit of 200, counted in keyed state."""
    rows = stream_of(spark, d, "feedback_events").where("actor_id <> ''").select("actor_id", "received_at", "ordinal")
    passed = feedback.run_append(feedback.rate_limited(rows, "actor_id", "received_at", 200), scratch(spark, "stream"))
    return passed.groupBy("actor_id", F.floor(F.unix_timestamp("received_at") / 86400).alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_accepted", "select ordinal from feedback_events where created_at >= received_at - interval 30 day and created_at <= received_at + interval 10 minute")
def stream_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Events made within thirty days before they came in, clocks at most ten minutes ahead."""
    rows = stream_of(spark, d, "feedback_events").where(feedback.in_window(F.col("created_at"), F.col("received_at"))).select("ordinal")
    return feedback.run_append(rows, scratch(spark, "stream"))


@query("stream_ledger", "select event_type as kind, cast(ts as date) as day, least(count(*), 100) as calls from events where ts is not null and event_type is not null group by 1, 2")
def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Calls per component and day within a budget of a hundred: the state begins anew each day."""
    rows = stream_of(spark, d, "events").where("ts is not null and event_type is not null").select(F.col("event_type").alias("kind"), "ts")
    passed = feedback.run_append(feedback.within_daily_budget(rows, "kind", "ts", 100), scratch(spark, "stream"))
    return passed.groupBy("kind", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"))


@query("stream_progress", "select count(*) as n from feedback_events")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """Rows taken over two runs that share a checkpoint: the second goes on where the first stopped and finds nothing new."""
    home = scratch(spark, "stream")
    for _ in range(2):
        taken = feedback.run_append(stream_of(spark, d, "feedback_events").select("ordinal"), home)
    return taken.agg(F.count(F.lit(1)).alias("n"))


@query("event_quarantine", """select ordinal, case when length(coalesce(cast(to_json(item_snapshot) as varchar), '')) > 4000 then 'size' when not coalesce(lower(trim(action)) in ('like', 'pass', 'clear'), false) then 'action' when coalesce(actor_id, '') = '' or coalesce(product_id, '') = '' then 'name' end as fault
  from feedback_events where length(coalesce(cast(to_json(item_snapshot) as varchar), '')) > 4000 or not coalesce(lower(trim(action)) in ('like', 'pass', 'clear'), false) or coalesce(actor_id, '') = '' or coalesce(product_id, '') = ''""")
def event_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Events that break a constraint, with the first one they break; they are written beside the good ones."""
    rows = table(spark, d, "feedback_events").withColumn("fault", feedback.fault(F.col("action"), F.col("actor_id"), F.col("product_id"), F.col("item_snapshot"), 4000))
    return materialise(rows.where("fault is not null").select("ordinal", "fault"), "quarantine")
