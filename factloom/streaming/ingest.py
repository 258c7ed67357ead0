"""Streams of facts: the same merge as in batch, inside ``foreachBatch``; sessions' timers in ``transformWithStateInPandas``.

No event-time watermark: nothing is ever too late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from factloom import facts as facts_ops
from factloom.sources.inbox import split_poison
from factloom.sources.tables import BucketedTable, VersionedTable
from factloom.types import FACT_DDL, TypeRegistry


class StreamingStore:
    """Facts kept by a streaming query; each micro-batch is one guarded commit, and a repeated one changes nothing."""

    def __init__(self, spark: SparkSession, base: str, types: TypeRegistry, epoch: int = 1):
        self.types, self.epoch = types, epoch
        self.facts = BucketedTable(spark, f"{base}/facts", FACT_DDL, "session_id")
        self.poison = VersionedTable(spark, f"{base}/quarantine", "session_id string, payload string, seq bigint, batch bigint")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merges one micro-batch of facts into the buckets of its sessions. The manifest remembers the batch, so a replay after a failure is seen and skipped."""
        now = self.facts.guard(self.epoch)
        if now.get("batch", -1) >= batch_id:
            return
        keyed = batch.withColumn("value_key", self.types.value_keys())
        merge = lambda state: facts_ops.apply_batch(state, keyed, facts_ops.revisions(state))
        self.facts.change(keyed, self.epoch, merge, now["version"], note={"batch": batch_id})
        self.facts.expire(keep=3)

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Runs the merge over a stream of facts until it is stopped, or once over all that is there."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def start_wire(self, stream: DataFrame, decode: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
        """As :meth:`start` for raw payloads (session_id, payload, seq): poison goes to its table, the rest is decoded and merged."""

        def each(batch: DataFrame, batch_id: int) -> None:
            good, bad = split_poison(batch)
            known = self.poison.read().filter(F.col("batch") == batch_id)
            if known.isEmpty():
                self.poison.commit(bad.select("session_id", "payload", F.col("seq").cast("bigint").alias("seq"), F.lit(batch_id).cast("bigint").alias("batch")), self.epoch, append=True)
            self.apply(decode(good), batch_id)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SessionTimers(StatefulProcessor):
    """Per session: a debounce window that arms once, a park timer that every arrival moves, and the count of arrivals.

    Emits (session_id, kind, n, at) with kind ``due`` or ``parked``. Timers are of processing time, so the query must be ended by
    ``processAllAvailable()`` and ``stop()``, never by ``availableNow``.
    """

    def __init__(self, debounce: timedelta, park_after: timedelta):
        self.debounce_ms, self.park_ms = int(debounce.total_seconds() * 1000), int(park_after.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "n bigint, due bigint, park bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        n, due, park = self.state.get() if self.state.exists() else (0, 0, 0)
        n += sum(len(x) for x in rows)
        if not due:
            due = now + self.debounce_ms
            self.handle.registerTimer(due)
        if park:
            self.handle.deleteTimer(park)
        park = now + self.park_ms
        self.handle.registerTimer(park)
        self.state.update((n, due, park))
        return iter(())  # arrivals emit nothing; timers do

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        n, due, park = self.state.get() if self.state.exists() else (0, 0, 0)
        kind = "due" if at == due else "parked"
        self.state.update((n, 0 if kind == "due" else due, 0 if kind == "parked" else park))
        yield pd.DataFrame({"session_id": [key[0]], "kind": [kind], "n": [n], "at": [at]})

    def close(self) -> None:
        """Nothing is held open."""


def session_timers(stream: DataFrame, debounce: timedelta, park_after: timedelta) -> DataFrame:
    """The stream of due and parked sessions. Needs the RocksDB state store."""
    return stream.groupBy("session_id").transformWithStateInPandas(SessionTimers(debounce, park_after), "session_id string, kind string, n bigint, at bigint", "Append", "ProcessingTime")


class KeyedMerge(StatefulProcessor):
    """The merge with state in the query itself: one state per identity, outcomes as output. Batches are merged before state is touched."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fact", "first_retrieved timestamp, last_retrieved timestamp, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("ins_seq")
        old = self.state.get() if self.state.exists() else None
        first = batch["first_retrieved"].iloc[0] if old is None else old[0]
        last = batch["last_retrieved"].max() if old is None else max(batch["last_retrieved"].max(), pd.Timestamp(old[1]))
        added = 1 if old is None else 0
        self.state.update((pd.Timestamp(first).to_pydatetime(), pd.Timestamp(last).to_pydatetime(), len(batch) + (old[2] if old else 0)))
        yield pd.DataFrame({"session_id": [key[0]], "type": [key[1]], "value_key": [key[2]], "added": [added], "updated": [len(batch) - added]})

    def close(self) -> None:
        """Nothing is held open."""


def stateful_merge(stream: DataFrame) -> DataFrame:
    """(session_id, type, value_key, added, updated) of each identity in each micro-batch."""
    return stream.groupBy("session_id", "type", "value_key").transformWithStateInPandas(KeyedMerge(), "session_id string, type string, value_key string, added bigint, updated bigint", "Update", "None")
