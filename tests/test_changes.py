"""The change feed: streamed in pieces and in any order, it equals a plain fold."""

import random
import time
from datetime import datetime, timedelta

import pytest

from leadlens.streaming import changes, feedback

SCHEMA = "event_id string, actor_id string, product_id string, action string, created_at timestamp, received_at timestamp, version int, v string"
T0 = datetime(2026, 1, 1)
LOW = datetime(1900, 1, 1)


def fold(rows):
    """The votes standing, by the rules alone."""
    latest = {}
    for r in rows:
        action = (r[3] or "").strip().lower()
        if not (r[0] and r[1] and r[2]) or action not in changes.ACTIONS:
            continue
        version = (r[5] or LOW, r[4] or LOW, r[1], r[2], action)
        if r[0] not in latest or version > latest[r[0]]:
            latest[r[0]] = version
    standing = {}
    for event, (received, created, actor, product, action) in latest.items():
        at = (created if created > LOW else received, received, event, action)
        standing[actor, product] = max(standing.get((actor, product), at), at)
    return sorted((a, p, v[2]) for (a, p), v in standing.items() if v[3] != "clear")


def feed(n, seed):
    rng = random.Random(seed)
    ids = [f"{i:08x}-0000-4000-8000-00000000000{i % 10}" for i in range(n // 2)] + ["odd id", "", None]
    when = lambda: rng.choice([None, *[T0 + timedelta(minutes=rng.randrange(50)) for _ in range(6)]])
    return [
        (rng.choice(ids), rng.choice(["a", "b", "00ff", None, ""]), rng.choice(["p", "q", "9d5d9137d9b3", None]),
         rng.choice(["like", "Pass ", " CLEAR", "view", None]), when(), when(), 1, "x")
        for _ in range(n)
    ]


@pytest.mark.parametrize("files", [1, 5])
def test_stream_equals_fold(spark, tmp_path, files):
    rows = feed(400, 11) * 2
    random.Random(1).shuffle(rows)
    for i in range(files):
        spark.createDataFrame(rows[i::files], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
    (tmp_path / "in").mkdir()
    for i in range(files):
        for part in (tmp_path / f"w{i}").glob("*.parquet"):
            part.rename(tmp_path / "in" / f"{i}.parquet")
    want = fold(rows)
    for each in (1, 1000):
        got = changes.replay(spark, f"file://{tmp_path}/in", each)
        assert sorted((r.actor_id, r.product_id, r.event_id) for r in got.collect()) == want
    batch = changes.standing_votes(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.actor_id, r.product_id, r.event_id) for r in batch.collect()) == want


def test_feed_goes_on_where_it_stopped(spark, tmp_path):
    rows = feed(200, 3)
    (tmp_path / "in").mkdir()
    for i in (0, 1):
        spark.createDataFrame(rows[i::2], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        changes.apply_changes(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    got = changes.current_state(spark, f"{tmp_path}/out")
    assert sorted((r.actor_id, r.product_id, r.event_id) for r in got.collect()) == fold(rows)


def test_empty_feed(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    assert changes.replay(spark, str(tmp_path / "in")).count() == 0


def test_stream_leaves_no_shuffle_files(spark, tmp_path):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    spark.createDataFrame(feed(400, 7), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    before = shuffled()
    votes = changes.replay(spark, str(tmp_path / "in"))
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert votes.count() > 0


def test_ids_survive_packing(spark):
    ids = ["", "a", "00d01b3f-8c5f-46b2-a312-46d3ec1c1b5b", "00D01B3F-8c5f-46b2-a312-46d3ec1c1b5b", "9d5d9137d9b3", "abc", "é水", "0" * 40]
    rows = spark.createDataFrame([(i,) for i in ids], "id string")
    assert [r[0] for r in rows.select(changes.unpack_id(changes.pack_id(rows.id))).collect()] == ids


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    rows = [r for r in feed(200, 5) if r[4]]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = feedback.daily_counts(feedback.deduplicated(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "event_id", "created_at", "90 days"), delay=None)
    query = stream.writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("daily").columns == ["day", "action", "n"]


def test_rate_limit_and_first_seen_streams(spark, tmp_path):
    rows = [(f"e{i}", "ab"[i % 2], "p", "like", T0, T0 + timedelta(minutes=i), 1, "x") for i in range(40)] + [("n", None, "p", "like", T0, T0, 1, "x")]
    (tmp_path / "in").mkdir()
    for i in range(2):
        spark.createDataFrame(rows[i * 20 : i * 20 + 21], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
    limited = feedback.rate_limited(reader.parquet(str(tmp_path / "in")), "actor_id", "received_at", 7)
    query = limited.writeStream.outputMode("append").format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "r")).trigger(availableNow=True).start()
    query.awaitTermination()
    counts = {r.actor_id: r["count"] for r in spark.table("limited").groupBy("actor_id").count().collect()}
    assert counts == {"a": 7, "b": 7}
    feedback.first_seen(reader.parquet(str(tmp_path / "in")), "actor_id", "received_at", f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r.actor_id: r.received_at for r in feedback.first_seen_table(spark, f"{tmp_path}/out", "actor_id", "received_at").collect()}
    assert got == {"a": T0, "b": T0 + timedelta(minutes=1)}
