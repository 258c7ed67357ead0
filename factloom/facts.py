"""Set operators over facts: keyed merge, outcomes, revisions, change sets, type filters, latest.

Facts are rows of ``FACT_DDL``; an identity is (session_id, type, value_key). The first arrival of an identity (least ``ins_seq``) gives every column
but ``last_retrieved``, which is the greatest seen. All sessions are handled at once, with the session as the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.types import IDENTITY, TypeRegistry

FIRST = ("namespace_id", "value", "retrieved_by", "first_retrieved")


def merge(facts: DataFrame) -> DataFrame:
    """One row for each identity: first arrival, greatest ``last_retrieved``. One shuffle, with partial aggregation before it."""
    columns = [c for c in facts.columns if c not in (*IDENTITY, "last_retrieved", "ins_seq")]
    first = F.min(F.struct("ins_seq", *columns))
    out = facts.groupBy(*IDENTITY).agg(first.alias("_first"), F.max("last_retrieved").alias("last_retrieved"))
    return out.select(*[F.col(c) if c in (*IDENTITY, "last_retrieved") else F.col(f"_first.{c}").alias(c) for c in facts.columns])


def outcomes(batch: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Adds ``outcome``, ADDED or UPDATED, to every presented row: only the first of an identity that was not there is ADDED."""
    order = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy("ins_seq"))
    df = batch.withColumn("_n", order)
    if existing is None:
        return df.withColumn("outcome", F.when(F.col("_n") == 1, "ADDED").otherwise("UPDATED")).drop("_n")
    known = existing.select(*IDENTITY).distinct().withColumn("_known", F.lit(True))
    return df.join(known, list(IDENTITY), "left").withColumn("outcome", F.when((F.col("_n") == 1) & F.col("_known").isNull(), "ADDED").otherwise("UPDATED")).drop("_n", "_known")


def apply_batch(state: DataFrame, batch: DataFrame, revisions: DataFrame) -> DataFrame:
    """State after a batch. ``revisions``: (session_id, revision) so far; a session whose facts change gets the next one.

    A new identity has both stamps at the new revision, one that became fresher only ``updated_rev``; an older or equal
    re-observation changes nothing. State and batch meet in one aggregation.
    """
    both = state.withColumn("_old", F.lit(True)).unionByName(batch.withColumn("_old", F.lit(False)), allowMissingColumns=True)
    was = lambda c: F.max(F.when(F.col("_old"), F.col(c)))
    # Existing rows come before anything that arrives.
    first = F.min(F.struct((~F.col("_old")).alias("late"), "ins_seq", *FIRST))
    merged = both.groupBy(*IDENTITY).agg(first.alias("_f"), F.max("last_retrieved").alias("last_retrieved"), was("last_retrieved").alias("_last"), was("added_rev").alias("_added"), was("updated_rev").alias("_updated"))
    merged = merged.join(revisions.select("session_id", "revision"), "session_id", "left").withColumn("_next", F.coalesce("revision", F.lit(0)) + 1)
    fresher = F.col("_last").isNotNull() & (F.col("last_retrieved") > F.col("_last"))
    stamps = {"added_rev": F.coalesce("_added", "_next"), "updated_rev": F.when(F.col("_added").isNull() | fresher, F.col("_next")).otherwise(F.col("_updated"))}
    return merged.withColumns(stamps).select(
        "session_id", F.col("_f.namespace_id").alias("namespace_id"), "type", F.col("_f.value").alias("value"), "value_key", F.col("_f.retrieved_by").alias("retrieved_by"),
        F.col("_f.first_retrieved").alias("first_retrieved"), "last_retrieved", "added_rev", "updated_rev", F.col("_f.ins_seq").alias("ins_seq"),
    )


def revisions(state: DataFrame) -> DataFrame:
    """(session_id, revision): the greatest stamp of each session."""
    return state.groupBy("session_id").agg(F.max("updated_rev").alias("revision"))


def stamp_batches(facts: DataFrame, batch: str) -> DataFrame:
    """``added_rev`` and ``updated_rev`` of every identity if the batches had been merged one after the other, in one pass."""
    per = facts.groupBy(*IDENTITY, F.col(batch).alias("_b")).agg(F.max("last_retrieved").alias("_last"))
    before = Window.partitionBy(*IDENTITY).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_best", F.max("_last").over(before))
    return per.groupBy(*IDENTITY).agg(F.min("_b").alias("added_rev"), F.max(F.when(F.col("_best").isNull() | (F.col("_last") > F.col("_best")), F.col("_b"))).alias("updated_rev"))


def change_set_since(state: DataFrame, revision: Column | int) -> DataFrame:
    """Rows that changed after ``revision`` with ``change``: added if they are new since, else updated."""
    rev = F.lit(revision) if isinstance(revision, int) else revision
    return state.withColumn("change", F.when(F.col("added_rev") > rev, "added").when(F.col("updated_rev") > rev, "updated")).filter("change is not null")


def operator_delta(state: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Each session's change set since its watermark (session_id, watermark); without one everything is added."""
    marked = state.join(watermarks.select("session_id", "watermark"), "session_id", "left")
    out = change_set_since(marked, F.coalesce("watermark", F.lit(-1)))
    return out.withColumn("is_first_invocation", F.col("watermark").isNull()).drop("watermark")


def of_type(facts: DataFrame, types: TypeRegistry, name: str) -> DataFrame:
    """Facts of the type or of any below it: a filter that reaches the scan."""
    return facts.filter(F.col("type").isin(types.leaves(name)))


def latest(facts: DataFrame, *by: str) -> DataFrame:
    """The newest fact of each group by ``last_retrieved``; between equals the one that arrived first."""
    newest = Window.partitionBy("session_id", *by).orderBy(F.desc("last_retrieved"), "ins_seq")
    return facts.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def contains(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The facts whose identity is among ``wanted``."""
    return facts.join(wanted.select(*IDENTITY).distinct(), list(IDENTITY), "left_semi")


def present_types(facts: DataFrame) -> DataFrame:
    return facts.select("session_id", "type").distinct()


def in_order(facts: DataFrame) -> DataFrame:
    """Insertion order, only where somebody asks for it."""
    return facts.orderBy("session_id", "ins_seq")
