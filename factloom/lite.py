"""The small form: the scheduling core in one call, with events, no stores, no aggregators.

Differences that are meant: edges match in either direction, any operator may consume, a capability gets one attempt to activate, an armed retry whose operator is not ready
any more ends, and the flow's deadline is hard: it cuts running operators short, and such a run is a failure that does not count as a run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.engine import Engine, Result
from factloom.flow import Flow
from factloom.operators.activation import Activator
from factloom.plans.graph import validate
from factloom.sources.control import EVENT_DDL, NullSink
from factloom.sources.workspace import local


@dataclass
class SessionResult:
    """``runs``: (session_id, operator_id, runs); ``failures``: (session_id, operator_id, detail)."""

    data_points: DataFrame
    runs: DataFrame
    failures: DataFrame
    deadline_hit: bool = False
    events: DataFrame | None = field(default=None)


def events_of(result: Result) -> DataFrame:
    """session_started, operator_finished and data_point_added rows in order, then session_finished."""
    spark = result.facts.sparkSession
    names = [c.split()[0] for c in EVENT_DDL.split(", ")]
    nothing = F.lit(None).cast("string")
    begun = result.sessions.select("session_id", F.lit("session_started").alias("kind"), nothing.alias("subject"), nothing.alias("outcome"), nothing.alias("detail"), F.lit(0).cast("bigint").alias("seq"))
    ran = result.runs.select("session_id", F.lit("operator_finished").alias("kind"), F.col("operator_id").alias("subject"), "outcome", "detail", (F.col("step") * 2).cast("bigint").alias("seq"))
    facts = result.facts.select("session_id", F.lit("data_point_added").alias("kind"), F.col("type").alias("subject"), F.lit("added").alias("outcome"), F.col("value").alias("detail"), (F.col("added_rev") * 2 - 1).cast("bigint").alias("seq"))
    ended = result.sessions.select("session_id", F.lit("session_finished").alias("kind"), nothing.alias("subject"), F.col("status").alias("outcome"), nothing.alias("detail"), F.lit(2**62).cast("bigint").alias("seq"))
    out = local(spark, [], EVENT_DDL)
    for part in (begun, ran, facts, ended):
        out = out.unionByName(part.select(*names))
    return out


def run_session(spark: SparkSession, flow: Flow, seed: DataFrame, sink=None, now=None) -> SessionResult:
    """Runs the flow over all sessions of the seed and publishes what happened."""
    validate([*flow.pruned, *flow.capabilities], flow.types, both_ways=True)
    activator = Activator(flow.capabilities, lambda namespace, capability: {}, max_attempts=1, timeout=flow.timeout) if Activator.needed(flow.capabilities) else None
    result = Engine(spark, activator=activator).run(flow, seed, now=now, lite=True)
    events = events_of(result)
    (sink or NullSink()).publish(events)
    counted = result.runs.filter("outcome <> 'cancelled'").groupBy("session_id", "operator_id").agg(F.count(F.lit(1)).alias("runs"))
    failed = result.runs.filter("outcome in ('failed', 'timed_out', 'cancelled')").select("session_id", "operator_id", "detail")
    return SessionResult(result.facts, counted, failed, result.deadline_hit, events)
