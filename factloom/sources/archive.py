"""The archive: one row for each (session, type, value hash), folded from an append buffer. Reads see the buffer too."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.sealing import CipherProvider, seal_facts, unseal_facts
from factloom.sources.tables import VersionedTable
from factloom.types import TypeRegistry

ARCHIVE_DDL = (
    "namespace_id string, session_id string, type string, value_hash string, value string, sealed boolean, retrieved_by string, "
    "first_retrieved timestamp_ntz, last_retrieved timestamp_ntz, epoch bigint, ins_seq bigint"
)
KEY = ("session_id", "type", "value_hash")


def fold(rows: DataFrame) -> DataFrame:
    """Keyed upsert: the first row of a key stands, ``last_retrieved`` and ``epoch`` are the greatest."""
    rest = [c for c in rows.columns if c not in (*KEY, "last_retrieved", "epoch", "ins_seq")]
    out = rows.groupBy(*KEY).agg(F.min(F.struct("ins_seq", *rest)).alias("_f"), F.max("last_retrieved").alias("last_retrieved"), F.max("epoch").alias("epoch"))
    return out.select(*[F.col(c) if c in (*KEY, "last_retrieved", "epoch") else F.col(f"_f.{c}").alias(c) for c in rows.columns])


def durable_only(facts: DataFrame, types: TypeRegistry) -> DataFrame:
    """Without ephemeral types."""
    return facts.filter(~F.col("type").isin(types.flagged("ephemeral")))


def live(rows: DataFrame, now: Column, retention: timedelta | None) -> DataFrame:
    """Rows within their retention, its last instant included."""
    return rows if retention is None else rows.filter(F.col("last_retrieved") + F.lit(retention) >= now)


class Archive:
    def __init__(self, spark: SparkSession, base: str, types: TypeRegistry, ciphers: CipherProvider | None = None, retention: timedelta | None = None):
        self.types, self.ciphers, self.retention = types, ciphers or CipherProvider(), retention
        self.table = VersionedTable(spark, f"{base}/archive", ARCHIVE_DDL)
        self.buffer = VersionedTable(spark, f"{base}/archive_buffer", ARCHIVE_DDL)

    def archive(self, facts: DataFrame, epoch: int) -> None:
        """Buffers facts; ephemeral ones are left out, personal ones sealed or refused."""
        self.table.guard(epoch)
        rows = seal_facts(durable_only(facts, self.types), self.types, self.ciphers).withColumn("epoch", F.lit(epoch).cast("bigint"))
        self.buffer.commit(rows.select(*[c.split()[0] for c in ARCHIVE_DDL.split(", ")]), epoch, append=True)

    def _all(self) -> DataFrame:
        return fold(self.table.read().unionByName(self.buffer.read()))

    def flush(self, epoch: int) -> int:
        """Folds the buffer into the table; how many rows were buffered."""
        n = self.buffered_count()
        self.table.commit(self._all(), epoch)
        self.buffer.commit(self.buffer.read().limit(0), epoch)
        return n

    def buffered_count(self) -> int:
        return self.buffer.read().count()

    def read(self, now: Column | None = None, unseal: bool = True) -> DataFrame:
        """Committed and buffered rows alike, by first retrieval, type and hash."""
        rows = self._all()
        rows = live(rows, now, self.retention) if now is not None else rows
        rows = unseal_facts(rows, self.ciphers) if unseal else rows
        return rows.orderBy("first_retrieved", "type", "value_hash")
