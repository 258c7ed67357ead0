"""The inbox: appended wire rows, claims, redelivery, poison, quarantine.

Rows are (entry_id, session_id, payload, seq). The state of deliveries is a table of its own, so appending never waits for readers.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.tables import BucketedTable, VersionedTable
from factloom.sources.workspace import materialize
from factloom.types import TypeRegistry

log = logging.getLogger("factloom")
ENTRY_DDL = "entry_id string, session_id string, payload string, seq bigint"
STATE_DDL = "entry_id string, session_id string, delivery_count int, status string, reason string"
ENVELOPE = "type string, value string, retrieved_by string, first_retrieved timestamp_ntz, last_retrieved timestamp_ntz"
MAX_DELIVERIES = 5


def entry_ids(rows: DataFrame) -> DataFrame:
    """Adds ids that a retried task makes again: a hash of session and sequence."""
    return rows.withColumn("entry_id", F.sha2(F.concat_ws("\x00", "session_id", F.col("seq").cast("string")), 256))


def numbered(rows: DataFrame, append: int) -> DataFrame:
    """Adds ids that no two entries share: rows of one session and sequence are told apart by their number among them (by payload; equal rows are alike, so a
    retried task gives the same ids) and by the append that brings them."""
    n = F.row_number().over(Window.partitionBy("session_id", "seq").orderBy("payload"))
    return rows.withColumn("entry_id", F.sha2(F.concat_ws("\x00", "session_id", F.col("seq").cast("string"), F.lit(str(append)), n.cast("string")), 256))


def split_poison(entries: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(good, poison): poison cannot be decoded as an object with a type at all. Unknown types and misfit values are no poison: :func:`decode` sets them
    aside, so that a newer producer's rows are not lost at once."""
    parsed = entries.withColumn("_v", F.try_parse_json(payload))
    kind = F.get_json_object(payload, "$.type")
    bad = F.col("_v").isNull() | kind.isNull() | F.get_json_object(payload, "$.value").isNull()
    return parsed.filter(~bad).drop("_v"), parsed.filter(bad).drop("_v")


def decode(good: DataFrame, types: TypeRegistry) -> tuple[DataFrame, DataFrame]:
    """(facts, bad) of decodable entries, in one pass: bad are (entry_id, session_id, reason) of unknown or abstract types and of values that do not fit their type.

    An entry is judged by itself, so one that cannot be applied holds up no other. The order of facts is the inbox's.
    """
    e = F.from_json("payload", "type string, retrieved_by string, first_retrieved timestamp_ntz, last_retrieved timestamp_ntz")
    raw = F.get_json_object("payload", "$.value")
    out = good.withColumn("_e", e).select("entry_id", "session_id", F.lit(None).cast("string").alias("namespace_id"), F.col("_e.type").alias("type"), raw.alias("_raw"), F.col("_e.retrieved_by").alias("retrieved_by"), F.col("_e.first_retrieved").alias("first_retrieved"), F.col("_e.last_retrieved").alias("last_retrieved"), F.col("seq").alias("ins_seq"))
    leaves = [x for x in types.names() if not types[x].abstract]
    strings = [x for x in leaves if types[x].value == "string"]
    quoted = F.when(F.col("type").isin(strings), F.to_json(F.struct(F.col("_raw").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("_raw").alias("v")))) - 6)).otherwise(F.col("_raw"))
    reason = F.when(F.col("type").isNull() | ~F.col("type").isin(leaves), F.concat(F.lit("unknown type "), F.coalesce("type", F.lit("null")))).when(types.misfit(), F.lit("misfit value"))
    judged = out.withColumn("value", quoted).drop("_raw").withColumn("_reason", reason)
    facts = judged.filter("_reason is null").drop("_reason").withColumn("value_key", types.value_keys())
    return facts, judged.filter("_reason is not null").select("entry_id", "session_id", F.col("_reason").alias("reason"))


class Inbox:
    """Append-only entries and their delivery state, which lies in buckets by entry: a drain rewrites the buckets of what it touches."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 8):
        self.entries = VersionedTable(spark, f"{base}/inbox", ENTRY_DDL)
        self.state = BucketedTable(spark, f"{base}/inbox_state", STATE_DDL, "entry_id", buckets)

    def append(self, rows: DataFrame, epoch: int = 0) -> int:
        """Adds (session_id, payload, seq). Entries that share a sequence, of this append or another, are entries of their own."""
        version = self.entries.version()
        rows = numbered(rows, version + 1).select("entry_id", "session_id", "payload", F.col("seq").cast("bigint").alias("seq"))
        return self.entries.commit(rows, max(epoch, self.entries.max_epoch()), version, append=True)

    def _with_state(self) -> DataFrame:
        return self.entries.read().join(self.state.read().drop("session_id"), "entry_id", "left")

    def consume(self, epoch: int, max_entries: int | None = None) -> DataFrame:
        """Claims what was never delivered, in order of arrival within each session; 0 or less claims nothing."""
        fresh = self._with_state().filter("status is null")
        if max_entries is not None:
            first = Window.partitionBy("session_id").orderBy("seq", "entry_id")
            fresh = fresh.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= max(0, max_entries)).drop("_n")
        return self._claim(fresh, epoch)

    def reclaim(self, epoch: int) -> DataFrame:
        """Delivers again what is claimed but not acknowledged, counting the delivery."""
        return self._claim(self._with_state().filter("status = 'claimed'"), epoch)

    def _claim(self, rows: DataFrame, epoch: int) -> DataFrame:
        taken = rows.select("entry_id", "session_id", "payload", "seq", (F.coalesce("delivery_count", F.lit(0)) + 1).alias("delivery_count"))
        self._put(taken.select("entry_id", "session_id", "delivery_count", F.lit("claimed").alias("status"), F.lit(None).cast("string").alias("reason")), epoch)
        claimed = self.state.read().filter("status = 'claimed'").select("entry_id", "delivery_count")
        return self.entries.read().join(claimed, "entry_id")

    def _put(self, changed: DataFrame, epoch: int) -> None:
        changed = materialize(changed, "inbox")
        if changed.isEmpty():
            self.state.commit(None, epoch)  # the epoch is recorded all the same
            return
        columns = ["entry_id", "session_id", "delivery_count", "status", "reason"]
        self.state.change(changed, epoch, lambda old: old.join(changed, "entry_id", "left_anti").select(*columns).unionByName(changed.select(*columns)))

    def ack(self, ids: DataFrame, epoch: int) -> None:
        """Settles claimed entries; unknown or unclaimed ids change nothing."""
        self.state.guard(epoch)
        hit = self.state.read().filter("status = 'claimed'").join(ids.select("entry_id").distinct(), "entry_id", "left_semi")
        self._put(hit.withColumn("status", F.lit("acked")), epoch)

    def quarantine(self, ids: DataFrame, epoch: int, reason: str) -> None:
        """Takes claimed entries out for good, with the reason."""
        self.state.guard(epoch)
        hit = self.state.read().filter("status = 'claimed'").join(ids.select("entry_id").distinct(), "entry_id", "left_semi")
        self._put(hit.withColumn("status", F.lit("quarantined")).withColumn("reason", F.lit(reason)), epoch)

    def quarantined(self) -> DataFrame:
        return self._with_state().filter("status = 'quarantined'").select("entry_id", "session_id", "payload", "delivery_count", "reason")

    def pending_count(self) -> DataFrame:
        """(session_id, pending): entries that are neither acknowledged nor quarantined."""
        return self._with_state().filter("status is null or status = 'claimed'").groupBy("session_id").agg(F.count(F.lit(1)).alias("pending"))

    def fresh_count(self) -> int:
        """Entries that were never delivered."""
        return self._with_state().filter("status is null").count()

    def drain(self, types: TypeRegistry, epoch: int, max_deliveries: int = MAX_DELIVERIES, max_entries: int | None = None) -> DataFrame:
        """Facts of everything that is claimed or can be; poison and what was delivered too often go to quarantine first.

        Entries of unknown types or misfit values stay claimed and are delivered again, up to the cap; those beside them are not touched by that.
        """
        self.reclaim(epoch)
        batch = self.consume(epoch, max_entries)
        self.quarantine(over_delivered(batch, max_deliveries), epoch, "delivered too often")
        good, poison = split_poison(batch.filter(F.col("delivery_count") <= max_deliveries))
        self.quarantine(poison, epoch, "poison")
        facts, bad = decode(good, types)
        told = {r["reason"]: r["count"] for r in bad.groupBy("reason").count().limit(20).collect()}
        if told:
            log.warning("entries that cannot be applied yet: %s", told)
        return facts


def over_delivered(batch: DataFrame, most: int | Column = MAX_DELIVERIES) -> DataFrame:
    """Entries that were delivered more often than allowed."""
    return batch.filter(F.col("delivery_count") > most)
