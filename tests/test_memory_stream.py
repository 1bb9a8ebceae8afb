"""Conversation memory as a stream against sessions over all messages at once."""

import random
from datetime import datetime, timedelta

import pytest

from docuflux.operators import operations as ops
from docuflux.streaming import memory

START = datetime(2024, 1, 1)


def test_written_memories():
    ttl, out = 100, []
    for at in (0, 50, 149, 250, 1000, 920, 2000):
        out = memory.written(out, at, f"m{at}", ttl)
    assert [(m["start"], m["last"], m["n"]) for m in out] == [(0, 149, 3), (250, 250, 1), (920, 1000, 2), (2000, 2000, 1)]
    # a late message joins what stood apart
    assert [(m["start"], m["last"], m["n"]) for m in memory.written(out, 200, "late", ttl)][0] == (0, 250, 5)
    assert [x[1] for x in memory.written(out, 120, "x", ttl)[0]["recent"]] == ["m0", "m50", "x", "m149"]


@pytest.fixture
def provider(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, memory.PROVIDER)
    yield
    spark.conf.set(name, before)


def test_stream_equals_sessions(spark, provider, tmp_path):
    """Files of messages, some of them late, in micro-batches; a write keeps a memory, silence drops it."""
    rng = random.Random(2)
    rows, at = [], 0
    for _ in range(120):
        at += rng.choice([1, 3, 10, 45])
        rows.append((rng.randint(1, 4), START + timedelta(minutes=at), f"at {at}"))
    late = [(u, ts - timedelta(minutes=8), f"{m} late") for u, ts, m in rows[::10]]
    end = [(9, START + timedelta(days=30), "the end")]
    schema, source = "user_id long, ts timestamp, message string", tmp_path / "in"
    size = 12
    for i in range(0, len(rows), size):
        part = rows[i : i + size] + [r for r in late if r[1] >= rows[i][1] - timedelta(minutes=9) and r[1] < rows[min(i + size, len(rows) - 1)][1] - timedelta(minutes=8)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}/{i:05d}")
    spark.createDataFrame(end, schema).coalesce(1).write.parquet(f"{source}/99999")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{source}/*")
    ttl = timedelta(minutes=30)
    query = memory.memories(stream, "user_id", ttl, "10 minutes").writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    sent = spark.read.schema(schema).parquet(*sorted(str(p) for p in source.iterdir()))
    wanted = {(r.user_id, r.start, r.last_ts, r.n) for r in ops.sessions(sent, "user_id", gap="30 minutes").filter("user_id < 9").collect()}
    got = spark.table("ended").collect()
    assert {(r.user_id, r.start, r.last_ts, r.n) for r in got} == wanted and len(got) == len(wanted) > 8
    messages = sorted((r.user_id, r.ts, r.message) for r in sent.collect())
    for r in got:
        own = [m for u, ts, m in messages if u == r.user_id and r.start <= ts <= r.last_ts]
        assert r.recent == own[-memory.RECENT :]


def test_sessions_have_the_same_ends(spark):
    ts = [0, 29, 59, 88]  # the third comes just as the time is over
    rows = spark.createDataFrame([(1, START + timedelta(minutes=m)) for m in ts], "user_id long, ts timestamp")
    assert [r.n for r in ops.sessions(rows, "user_id", gap="30 minutes").orderBy("start").collect()] == [2, 2]
    out = []
    for m in ts:
        out = memory.written(out, m, "", 30)
    assert [m["n"] for m in out] == [2, 2]
