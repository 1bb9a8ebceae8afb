"""Conversation memory as a stream: state that each write keeps alive and that silence drops."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docuflux.session import ship

#: The state store that timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Messages that a memory keeps.
RECENT = 6
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def micros(ts: datetime) -> int:
    return (ts.astimezone(UTC) - EPOCH) // timedelta(microseconds=1)


def moment(at: int) -> datetime:
    return EPOCH + timedelta(microseconds=at)


def written(memories: list[dict], at: int, message: str | None, ttl: int) -> list[dict]:
    """The memories of a key with one more message: those within the time to live of it become one."""
    near = [m for m in memories if m["start"] - at < ttl and at - m["last"] < ttl]
    rest = [m for m in memories if m not in near]
    recent = sorted([x for m in near for x in m["recent"]] + [[at, message]], key=lambda x: (x[0], x[1] or ""))[-RECENT:]
    one = {"start": min([at, *[m["start"] for m in near]]), "last": max([at, *[m["last"] for m in near]]), "n": 1 + sum(m["n"] for m in near), "recent": recent}
    return sorted([*rest, one], key=lambda m: m["start"])


class Memory(StatefulProcessor):
    """A key's memories that may still change, as JSON in one value, and one timer for the first that ends.

    A memory ends when the watermark has passed its last message by the time to live: messages that
    come later are later than that, so an ended memory is as a batch over all messages has it.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("memories", "memories string")

    def _keep(self, memories: list[dict]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if memories:
            self.state.update((json.dumps(memories),))
            self.handle.registerTimer(-(-min(m["last"] + self.ttl for m in memories) // 1000))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        memories = json.loads(self.state.get()[0]) if self.state.exists() else []
        for row in rows:
            memories = written(memories, micros(row.ts), row.message, self.ttl)
        self._keep(memories)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        memories = json.loads(self.state.get()[0]) if self.state.exists() else []
        ended = [m for m in memories if m["last"] + self.ttl <= now]
        self._keep([m for m in memories if m["last"] + self.ttl > now])
        for m in ended:
            yield Row(key=key[0], start=moment(m["start"]), last_ts=moment(m["last"]), n=m["n"], recent=[x[1] for x in m["recent"]])

    def close(self) -> None:
        pass


def memories(messages: DataFrame, key: str, ttl: timedelta, lateness: str = "10 minutes") -> DataFrame:
    """Each memory once it has ended: key, start, last_ts, n, recent (the last messages, oldest first).

    messages: a stream with `key` (integer), ts, message. A message keeps its key's memory for another
    `ttl`; one that comes later than that begins a new memory. Messages up to `lateness` late count
    where they belong. Rows without a key or time are left out. The session needs `PROVIDER` as state store.
    """
    ship(messages.sparkSession)
    rows = messages.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).cast("long").alias("key"), "ts", F.col("message").cast("string").alias("message")).withWatermark("ts", lateness)
    kind = "key long, start timestamp, last_ts timestamp, n long, recent array<string>"
    return rows.groupBy("key").transformWithState(Memory(ttl // timedelta(microseconds=1)), kind, "Append", "EventTime").withColumnRenamed("key", key)
