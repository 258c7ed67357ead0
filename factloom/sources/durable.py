"""Durable outputs: versioned documents by (table, key), sets, contribution marks. Batches are merged by key in one full join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.errors import VersionConflictError
from factloom.sources.tables import VersionedTable
from factloom.sources.workspace import materialize

DOCUMENT_DDL = "table_name string, key string, document string, version bigint, epoch bigint, status string, updated_at timestamp_ntz"
MEMBER_DDL = "table_name string, key string, field string, member string"
MARK_DDL = "session_id string, operator_id string, epoch bigint"
FINAL, INTERIM = "final", "in_progress"


def accepted(writes: DataFrame, by: tuple[str, ...] = ("table_name", "key"), epoch: str = "epoch", order: str = "seq") -> DataFrame:
    """Adds ``accepted``: false for a write under a lower epoch than some write before it for the same key."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return writes.withColumn("accepted", F.coalesce(F.col(epoch) >= F.max(epoch).over(before), F.lit(True)))


def versions(writes: DataFrame, by: tuple[str, ...] = ("table_name", "key"), order: str = "seq") -> DataFrame:
    """Adds ``version``: the ordinal of each accepted write of its key."""
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return accepted(writes, by, order=order).withColumn("version", F.sum(F.col("accepted").cast("bigint")).over(so_far)).filter("accepted")


def settle(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored documents after a batch (one row for each key): versions go up by one, and an interim write never replaces a final one."""
    s, b = stored.alias("s"), batch.alias("b")
    both = s.join(b, (F.col("s.table_name") == F.col("b.table_name")) & (F.col("s.key") == F.col("b.key")), "full_outer")
    take = F.col("b.key").isNotNull() & ~F.coalesce((F.col("b.status") == INTERIM) & (F.col("s.status") == FINAL), F.lit(False))
    pick = lambda c: F.when(take, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    version = (F.coalesce("s.version", F.lit(0)) + F.when(take, 1).otherwise(0)).cast("bigint").alias("version")
    return both.select(F.coalesce("s.table_name", "b.table_name").alias("table_name"), F.coalesce("s.key", "b.key").alias("key"), pick("document"), version, F.greatest("s.epoch", "b.epoch").alias("epoch"), pick("status"), pick("updated_at"))


class DurableStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.documents = VersionedTable(spark, f"{base}/documents", DOCUMENT_DDL)
        self.members = VersionedTable(spark, f"{base}/sets", MEMBER_DDL)
        self.marks = VersionedTable(spark, f"{base}/contributions", MARK_DDL)

    def read(self, table: str, key: str | None = None) -> DataFrame:
        df = self.documents.read().filter(F.col("table_name") == table)
        return df if key is None else df.filter(F.col("key") == key)

    def upsert(self, batch: DataFrame, epoch: int, expected: DataFrame | None = None) -> int:
        """``batch``: (table_name, key, document, status, updated_at). ``expected``: (table_name, key, version) that must be what is stored (0:
        absent); one mismatch refuses the whole batch, though its epoch is recorded all the same."""
        base = self.documents.version()
        self.documents.guard(epoch)
        stored = self.documents.read()
        if expected is not None:
            now = expected.alias("e").join(stored.alias("s"), (F.col("e.table_name") == F.col("s.table_name")) & (F.col("e.key") == F.col("s.key")), "left")
            if not now.filter(F.coalesce("s.version", F.lit(0)) != F.col("e.version")).isEmpty():
                self.documents.commit(None, epoch, base)
                raise VersionConflictError("a document has another version")
        merged = settle(stored, batch.withColumn("epoch", F.lit(epoch).cast("bigint")).withColumn("version", F.lit(0).cast("bigint")))
        return self.documents.commit(merged, epoch, base)

    def add_to_set(self, rows: DataFrame, epoch: int) -> DataFrame:
        """Adds (table_name, key, field, member) and returns (table_name, key, field, cardinality) of the touched sets."""
        base = self.members.version()
        rows = materialize(rows.select("table_name", "key", "field", "member"), "members")
        self.members.commit(self.members.read().unionByName(rows).distinct(), epoch, base)
        return set_cardinality(self.members.read().join(rows.select("table_name", "key", "field").distinct(), ["table_name", "key", "field"], "left_semi"))

    def mark_contributions(self, pairs: DataFrame, epoch: int) -> None:
        """At most one mark for each (session, aggregator)."""
        base = self.marks.version()
        new = pairs.select("session_id", "operator_id").distinct().withColumn("epoch", F.lit(epoch).cast("bigint")).join(self.marks.read(), ["session_id", "operator_id"], "left_anti")
        self.marks.commit(materialize(new.select("session_id", "operator_id", "epoch"), "marks"), epoch, base, append=True)

    def unmarked(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.marks.read(), ["session_id", "operator_id"], "left_anti")

    def clear_contributions(self, sessions: DataFrame, epoch: int) -> None:
        """For sessions that reopen."""
        base = self.marks.version()
        self.marks.commit(self.marks.read().join(sessions.select("session_id").distinct(), "session_id", "left_anti"), epoch, base)


def set_cardinality(members: DataFrame, *by: str) -> DataFrame:
    return members.groupBy(*(by or ("table_name", "key", "field"))).agg(F.count_distinct("member").alias("cardinality"))
