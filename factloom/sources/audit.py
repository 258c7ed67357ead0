"""The audit trail: append-only rows with a contiguous sequence per session, coalesced where types allow it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.sealing import CipherProvider, audit_summary
from factloom.sources.tables import VersionedTable
from factloom.types import TypeRegistry

AUDIT_DDL = "session_id string, sequence bigint, kind string, subject string, outcome string, detail string, n bigint, epoch bigint, at timestamp_ntz"
KINDS = ("data_point", "data_point_summary", "operator_run", "capability", "capability_action", "aggregation", "session_parked", "flow_drift", "quarantine")
OUTCOMES = ("succeeded", "failed", "timed_out", "retrying", "cancelled", "skipped")


def allocate(rows: DataFrame, last: DataFrame, order: str) -> DataFrame:
    """Adds ``sequence``: a contiguous range for each session after (session_id, last)."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(order))
    return rows.withColumn("_n", n).join(last, "session_id", "left").withColumn("sequence", (F.coalesce("last", F.lit(0)) + F.col("_n")).cast("bigint")).drop("_n", "last")


def coalesced_counts(outcomes: DataFrame, types: TypeRegistry) -> DataFrame:
    """(session_id, type, reason, n) of merges that get no row of their own: re-observations, and additions of an ephemeral type.

    Types that audit every emission are not coalesced.
    """
    quiet = outcomes.filter(~F.col("type").isin(types.flagged("audit_every_emission")))
    ephemeral = F.col("type").isin(types.flagged("ephemeral"))
    reason = F.when(F.col("outcome") == "UPDATED", "re-observed").when(ephemeral, "merged")
    return quiet.withColumn("reason", reason).filter("reason is not null").groupBy("session_id", "type", "reason").agg(F.count(F.lit(1)).alias("n"))


def merge_rows(outcomes: DataFrame, types: TypeRegistry, epoch: int, ciphers: CipherProvider | None = None) -> DataFrame:
    """Audit rows of a merge: one for each addition, one count for each coalesced group."""
    single = (F.col("outcome") == "ADDED") & ~F.col("type").isin(types.flagged("ephemeral")) | F.col("type").isin(types.flagged("audit_every_emission"))
    rows = outcomes.filter(single).select("session_id", F.lit("data_point").alias("kind"), F.col("type").alias("subject"), "outcome", audit_summary(types, ciphers=ciphers).alias("detail"), F.lit(1).cast("bigint").alias("n"), F.col("last_retrieved").alias("at"))
    counts = coalesced_counts(outcomes, types).select("session_id", F.lit("data_point_summary").alias("kind"), F.col("type").alias("subject"), F.lit(None).cast("string").alias("outcome"), F.col("reason").alias("detail"), "n", F.lit(None).cast("timestamp_ntz").alias("at"))
    return rows.unionByName(counts).withColumn("epoch", F.lit(epoch).cast("bigint"))


def run_rows(runs: DataFrame) -> DataFrame:
    """Audit rows of a run log: one for each attempt."""
    return runs.select("session_id", F.lit("operator_run").alias("kind"), F.col("operator_id").alias("subject"), "outcome", "detail", F.lit(1).cast("bigint").alias("n"), "at")


def event_rows(rows: DataFrame, kind: str, outcome: str | None = None) -> DataFrame:
    """Audit rows of sessions to which something happened: a park, drift, quarantine, or an aggregator that was skipped. ``subject`` and ``detail`` are taken if there."""
    own = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c)
    return rows.select("session_id", F.lit(kind).alias("kind"), own("subject"), F.lit(outcome).cast("string").alias("outcome"), own("detail"), F.lit(1).cast("bigint").alias("n"))


class AuditTrail:
    def __init__(self, spark: SparkSession, base: str):
        self.table = VersionedTable(spark, f"{base}/audit", AUDIT_DDL)

    def append(self, rows: DataFrame, epoch: int) -> None:
        """Adds rows without sequences, by ``_part`` if they have it; a lower epoch than any before is refused."""
        self.table.guard(epoch)
        # Only sessions that get rows are looked up, and of what is stored only two columns are read.
        mine = rows.select("session_id").distinct()
        last = self.table.read().select("session_id", "sequence").join(mine, "session_id", "left_semi").groupBy("session_id").agg(F.max("sequence").alias("last"))
        order = F.struct(*[c for c in ("_part", "kind", "subject", "outcome", "detail", "at") if c in rows.columns])
        done = allocate(rows.withColumn("_o", order), last, "_o").drop("_o")
        self.table.commit(done.select(*[c.split()[0] for c in AUDIT_DDL.split(", ")]), epoch, append=True)

    def replay(self, session_id: str) -> Iterator[Row]:
        """One session's rows in order, a partition at a time."""
        return self.table.read().filter(F.col("session_id") == session_id).orderBy("sequence").toLocalIterator()
