"""Read-only views of sessions: what is there, what is ready, what is missing; and running history again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import facts as facts_ops
from factloom.engine import Engine, Result
from factloom.flow import Flow
from factloom.plans import completion as conditions
from factloom.plans import readiness
from factloom.sources.workspace import local


def counts_by_type(facts: DataFrame) -> DataFrame:
    return facts.groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("n"))


def describe(flow: Flow, facts: DataFrame, op_state: DataFrame | None = None) -> dict[str, DataFrame]:
    """``types``, ``ready``, ``missing`` (one row for each lacking dependency), ``complete`` and ``revisions`` by session."""
    spark = facts.sparkSession
    sessions = facts.select("session_id").distinct()
    have = readiness.present_ancestors(facts, flow.types)
    nodes = [*flow.pruned, *flow.aggregators]
    wants = readiness.declared(spark, nodes, "depends_on")
    ids = local(spark, [(x.operator_id,) for x in nodes], "operator_id string")
    ready = readiness.ready(sessions, have, wants, ids)
    if op_state is not None:
        ready = ready.join(op_state.filter("runs > 0"), ["session_id", "operator_id"], "left_anti")
    complete = conditions.satisfied(facts, sessions, flow.completes_when, flow.types) if flow.completes_when is not None else sessions.withColumn("satisfied", F.lit(True))
    return {"types": counts_by_type(facts), "ready": ready, "missing": readiness.readiness_gap(sessions, have, wants), "complete": complete, "revisions": facts_ops.revisions(facts)}


def render_text(flow: Flow, facts: DataFrame, session_id: str, op_state: DataFrame | None = None) -> str:
    """One session in words; its rows are a handful."""
    views = {k: v.filter(F.col("session_id") == session_id).collect() for k, v in describe(flow, facts, op_state).items()}
    lines = [f"session {session_id}, revision {views['revisions'][0]['revision'] if views['revisions'] else 0}"]
    lines += [f"  has {r['n']} {r['type']}" for r in sorted(views["types"], key=lambda r: r["type"])]
    lines += [f"  {x} is ready" for x in sorted(r["operator_id"] for r in views["ready"])]
    lines += [f"  {a} lacks {b}" for a, b in sorted((r["operator_id"], r["missing"]) for r in views["missing"])]
    lines.append("  complete" if views["complete"] and views["complete"][0]["satisfied"] else "  not complete")
    return "\n".join(lines)


def replay(engine: Engine, flow: Flow, archived: DataFrame, now=None) -> Result:
    """Runs archived facts as a seed on a fresh state, with every capability permitted unless the engine has a catalog."""
    seed = archived.select("session_id", "namespace_id", "type", "value", "retrieved_by", "first_retrieved", "last_retrieved", "ins_seq")
    return engine.run(flow, seed, now=now)
