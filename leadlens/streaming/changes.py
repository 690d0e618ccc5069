"""Problem 6: apply a feed of inserts, updates and deletes and rebuild the current state.

Structured Streaming keeps one state entry per event: the last sequence seen, the payload, and
whether it is a tombstone. A later change replaces the entry only if its sequence is higher, so
repeated and out-of-order changes leave the same state. Each micro-batch writes the entries it
changed to ``version=<batch id>`` with overwrite: running a batch again writes the same rows, so
the output is idempotent. ``current_state`` folds the versions into the standing rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.session import drop_path, is_file, let_go, scratch

#: Actions that change a vote; the last one withdraws it.
ACTIONS = ("like", "pass", "clear")
TOMBSTONE = "clear"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pack_id(c: Column) -> Column:
    """An identifier in about half the bytes: UUIDs and other even runs of lower-case hex digits as the bytes they spell."""
    return (
        F.when(c.rlike("^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.concat(F.lit(b"\x01"), F.unhex(F.translate(c, "-", ""))))
        .when(c.rlike("^(?:[0-9a-f]{2})+$"), F.concat(F.lit(b"\x02"), F.unhex(c)))
        .otherwise(F.concat(F.lit(b"\x00"), F.encode(c, "UTF-8")))
    )


def unpack_id(c: Column) -> Column:
    """The identifier that ``pack_id`` packed."""
    kind, rest = F.hex(F.substring(c, 1, 1)), F.substr(c, F.lit(2))
    spelled = F.lower(F.hex(rest))
    return (
        F.when(kind == "01", F.regexp_replace(spelled, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
        .when(kind == "02", spelled)
        .otherwise(F.decode(rest, "UTF-8"))
    )


def clean_action(c: Column) -> Column:
    """The action without outer blanks and letter case."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}\p{Cc}\p{Cf}]+|[\s\p{Z}\p{Cc}\p{Cf}]+$", ""))


def valid_changes(events: DataFrame, *extra: str) -> DataFrame:
    """Rows that are changes, with a clean ``action``; rows without event, actor or product or with another action are none."""
    return (
        events.select("event_id", "actor_id", "product_id", clean_action(F.col("action")).alias("action"), "created_at", "received_at", *extra)
        .where(F.col("action").isin(*ACTIONS))
        .where("event_id <> '' and actor_id <> '' and product_id <> ''")
    )


def _latest_version(*extra: str) -> Column:
    """Of rows with one event_id: the one received last; equal ones by content, so that the result is defined."""
    fields = ["received_at", "created_at", "actor_id", "product_id", "action", *extra]
    return F.max(F.struct(*fields)).alias("v")


def latest_events(changes: DataFrame, *extra: str) -> DataFrame:
    """One row per event_id: the version received last (null times count as oldest)."""
    return changes.groupBy("event_id").agg(_latest_version(*extra)).select("event_id", "v.*")


def standing(events: DataFrame, *extra: str) -> DataFrame:
    """The votes standing: of each actor and product the last event, unless it is a withdrawal."""
    last = F.max(F.struct(F.coalesce("created_at", "received_at").alias("at"), "received_at", "event_id", "action", *extra)).alias("v")
    return (
        events.groupBy("actor_id", "product_id").agg(last)
        .where(F.col("v.action") != TOMBSTONE)
        .select("actor_id", "product_id", "v.event_id", "v.action", *[f"v.{e}" for e in extra])
    )


def standing_votes(events: DataFrame, *extra: str) -> DataFrame:
    """Batch form: the same result as the stream, for use inside other operators."""
    packed = valid_changes(events, *extra).withColumns({c: pack_id(F.col(c)) for c in ("event_id", "actor_id", "product_id")})
    latest = latest_events(packed, *extra).withColumn("event_id", unpack_id(F.col("event_id")))
    return standing(latest, *extra).withColumns({c: unpack_id(F.col(c)) for c in ("actor_id", "product_id")})


def write_versions(entries: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream of changed state entries to its present end; each micro-batch overwrites ``version=<batch id>``."""

    def upsert(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={version}")

    query = (
        entries.writeStream.outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).foreachBatch(upsert).start()
    )
    query.awaitTermination()


def apply_changes(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run the change feed ``stream`` to its present end; writes versions of the changed entries to ``out``.

    May be called again with the same folders when more has arrived: the state goes on from where
    it was. A batch that failed half-way is written again under its own version.
    """
    packed = valid_changes(stream).withColumns({c: pack_id(F.col(c)) for c in ("event_id", "actor_id", "product_id")})
    write_versions(packed.groupBy("event_id").agg(_latest_version()).select("event_id", "v.*"), out, checkpoint)


def current_state(spark: SparkSession, out: str) -> DataFrame:
    """The standing votes after all versions in ``out``."""
    upserts = spark.read.parquet(out)
    newest = F.max_by(F.struct("received_at", "created_at", "actor_id", "product_id", "action"), F.col("version")).alias("v")
    events = upserts.groupBy("event_id").agg(newest).select(unpack_id(F.col("event_id")).alias("event_id"), "v.*")
    return standing(events).withColumns({c: unpack_id(F.col(c)) for c in ("actor_id", "product_id")})


def replay(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Apply all changes in the Parquet files of ``path`` as a stream and return the standing votes.

    An empty feed gives an empty result. Other columns of the files are not read.
    """
    schema = spark.read.parquet(path).schema
    home = scratch(spark, "changes")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        folder, name = path.rstrip("/").rsplit("/", 1)
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        stream = reader.option("pathGlobFilter", name).parquet(folder) if is_file(spark, path) else reader.parquet(path)
        empty = valid_changes(spark.createDataFrame([], schema)).select(
            *[pack_id(F.col(c)).alias(c) if c.endswith("_id") else c for c in ("event_id", "received_at", "created_at", "actor_id", "product_id", "action")]
        )
        empty.write.parquet(f"{home}/out/version=-1")
        apply_changes(stream, f"{home}/out", f"{home}/state")
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    drop_path(spark, f"{home}/state")
    let_go(spark)  # the stream's shuffle files, before reading the versions makes more
    return current_state(spark, f"{home}/out")
