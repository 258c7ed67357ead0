"""Readiness as relational division, gaps, rerun triggers, capability availability, provider choice.

Declarations are small tables by construction (operators times declared types); they are joined to what sessions hold, once for all sessions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.plans.graph import Node, node_id
from factloom.sources.workspace import local, materialize
from factloom.types import TypeRegistry


def declared(spark: SparkSession, nodes: Sequence[Node], what: str) -> DataFrame:
    """(operator_id, wanted) of ``depends_on``, ``uses`` or ``requires``."""
    return local(spark, [(node_id(x), w) for x in nodes for w in sorted(set(getattr(x, what)))], "operator_id string, wanted string")


def present_ancestors(facts: DataFrame, types: TypeRegistry) -> DataFrame:
    """(session_id, wanted): every type that some fact of the session satisfies."""
    lineage = types.lineage(facts.sparkSession)
    return facts.select("session_id", "type").distinct().join(F.broadcast(lineage), F.col("type") == F.col("leaf")).select("session_id", F.col("ancestor").alias("wanted")).distinct()


def ready(sessions: DataFrame, have: DataFrame, wants: DataFrame, operators: DataFrame) -> DataFrame:
    """(session_id, operator_id) pairs all of whose wants the session has; an operator without wants is ready everywhere.

    ``have``: (session_id, wanted); ``wants``: (operator_id, wanted); ``operators``: (operator_id). Division by counting.
    """
    need = operators.join(wants.groupBy("operator_id").agg(F.count_distinct("wanted").alias("n")), "operator_id", "left").fillna(0, ["n"])
    met = have.join(F.broadcast(wants), "wanted").groupBy("session_id", "operator_id").agg(F.count_distinct("wanted").alias("m"))
    some = met.join(F.broadcast(need.filter("n > 0")), "operator_id").filter("m = n").select("session_id", "operator_id")
    free = need.filter("n = 0").select(F.collect_set("operator_id").alias("_all"))
    every = sessions.select("session_id").distinct().withColumn("_k", F.lit(1)).join(F.broadcast(free.withColumn("_k", F.lit(1))), "_k")
    return some.unionByName(every.select("session_id", F.explode("_all").alias("operator_id")))


def readiness_gap(sessions: DataFrame, have: DataFrame, wants: DataFrame) -> DataFrame:
    """(session_id, operator_id, missing): one row for each want that the session lacks; :func:`by_name` sorts them."""
    wanted = wants.select("operator_id", F.col("wanted")).groupBy().agg(F.collect_list(F.struct("operator_id", "wanted")).alias("_w")).withColumn("_k", F.lit(1))
    every = sessions.select("session_id").distinct().withColumn("_k", F.lit(1)).join(F.broadcast(wanted), "_k").select("session_id", F.explode("_w").alias("w")).select("session_id", "w.*")
    return every.join(have, ["session_id", "wanted"], "left_anti").select("session_id", "operator_id", F.col("wanted").alias("missing"))


def by_name(gap: DataFrame) -> DataFrame:
    """(session_id, operator_id, missing) with the missing names of a pair as one sorted array."""
    return gap.groupBy("session_id", "operator_id").agg(F.array_sort(F.collect_set("missing")).alias("missing"))


def relevant_new_data(delta: DataFrame, types: TypeRegistry, triggers: DataFrame) -> DataFrame:
    """(session_id, operator_id) with a relevant change: ``delta`` has (session_id, operator_id, type, change).

    ``triggers``: (operator_id, wanted, added_only) from ``depends_on`` and ``uses``; an operator that reruns on additions only ignores updates.
    """
    lineage = types.lineage(delta.sparkSession)
    leaves = triggers.join(lineage, triggers.wanted == lineage.ancestor).select(F.col("operator_id").alias("_op"), F.col("leaf"), "added_only").distinct()
    on = (F.col("operator_id") == F.col("_op")) & (F.col("type") == F.col("leaf")) & (~F.col("added_only") | (F.col("change") == "added"))
    return delta.join(F.broadcast(leaves), on, "left_semi").select("session_id", "operator_id").distinct()


def available_capabilities(sessions: DataFrame, have: DataFrame, spark: SparkSession, capabilities: Sequence, permitted: DataFrame | None = None) -> DataFrame:
    """(session_id, capability_id): the least fixpoint of permitted, dependencies present, and required kinds available.

    ``permitted``: (session_id, capability_id); None permits all. Rounds are bounded by the number of capabilities.
    """
    ids = local(spark, [(c.capability_id,) for c in capabilities], "operator_id string")
    kinds = local(spark, [(c.capability_id, k) for c in capabilities for k in {*c.kinds, c.capability_id}], "capability_id string, wanted string")
    fit = ready(sessions, have, declared(spark, capabilities, "depends_on"), ids).withColumnRenamed("operator_id", "capability_id")
    if permitted is not None:
        fit = fit.join(permitted, ["session_id", "capability_id"], "left_semi")
    needs = declared(spark, capabilities, "requires")
    provided = local(spark, [], "session_id string, wanted string")
    if any(c.requires for c in capabilities):
        fit = materialize(fit, "fit")  # every round reads it
    out = fit.limit(0)
    for _ in range(_depth(capabilities)):
        open_ = ready(sessions, provided, needs, ids).withColumnRenamed("operator_id", "capability_id")
        out = fit.join(open_, ["session_id", "capability_id"], "left_semi")
        provided = out.join(F.broadcast(kinds), "capability_id").select("session_id", "wanted").distinct()
    return out


def _depth(capabilities: Sequence) -> int:
    """Rounds until nothing can change: the longest chain of requirements, which declarations tell."""
    level: dict[str, int] = {}
    for _ in range(len(capabilities) + 1):
        for c in capabilities:
            below = [level[p.capability_id] for r in c.requires for p in capabilities if p.capability_id in level and (r in p.kinds or r == p.capability_id)]
            if not c.requires or below:
                level[c.capability_id] = min(len(capabilities), 1 + max(below, default=0))
    return max(level.values(), default=1)


def resolve_providers(available: DataFrame, kinds: DataFrame, preferred: DataFrame) -> DataFrame:
    """(session_id, kind, capability_id, rank): preferred ones first, then by id.

    ``kinds``: (capability_id, kind); ``preferred``: (session_id, capability_id, position).
    """
    offered = available.join(F.broadcast(kinds), "capability_id").join(preferred, ["session_id", "capability_id"], "left")
    order = Window.partitionBy("session_id", "kind").orderBy(F.coalesce("position", F.lit(2**31 - 1)), "capability_id")
    return offered.withColumn("rank", F.row_number().over(order)).select("session_id", "kind", "capability_id", "rank")


def permitted_operators(pairs: DataFrame, grants: DataFrame | None) -> DataFrame:
    """Pairs (namespace_id, operator_id) that the namespace permits. ``grants``: (namespace_id, operator_id or null for all); a namespace
    without a row permits nothing; None as a whole permits all."""
    if grants is None:
        return pairs
    everything = grants.filter("operator_id is null").select("namespace_id").distinct()
    free = pairs.join(everything, "namespace_id", "left_semi")
    some = pairs.join(everything, "namespace_id", "left_anti").join(grants.filter("operator_id is not null"), ["namespace_id", "operator_id"], "left_semi")
    return free.unionByName(some)


def newly_available(available: DataFrame, seen: DataFrame) -> DataFrame:
    """(session_id, capability_id) of ``available`` that were not ``seen`` before."""
    return available.select("session_id", "capability_id").distinct().join(seen, ["session_id", "capability_id"], "left_anti")


def reachable_pending(have: DataFrame, sessions: DataFrame, pending: DataFrame, nodes: Sequence[Node], types: TypeRegistry, provided: DataFrame | None = None) -> DataFrame:
    """(session_id, operator_id) of ``pending`` pairs that are ready, or would be if all reachable ones emitted what they declare.

    ``have``: (session_id, wanted); ``provided``: (session_id, wanted) kinds of available capabilities, which gate as in planning (None: no gate).
    A least fixpoint in as many rounds as the longest chain of declarations, not of data.
    """
    spark = have.sparkSession
    ids = local(spark, [(node_id(x),) for x in nodes], "operator_id string")
    wants = declared(spark, nodes, "depends_on")
    makes = local(spark, [(node_id(x), a) for x in nodes for p in getattr(x, "produces", ()) for leaf in types.leaves(p) for a in types.ancestors(leaf)], "operator_id string, wanted string").distinct()
    open_ = pending.select("session_id", "operator_id")
    if provided is not None:
        open_ = open_.join(ready(sessions, provided, declared(spark, nodes, "requires"), ids), ["session_id", "operator_id"], "left_semi")
    out, reach = open_.limit(0), have
    for _ in range(_chain(nodes, types)):
        out = ready(sessions, reach, wants, ids).join(open_, ["session_id", "operator_id"], "left_semi")
        reach = have.unionByName(out.join(F.broadcast(makes), "operator_id").select("session_id", "wanted")).distinct()
    return out


def _chain(nodes: Sequence[Node], types: TypeRegistry) -> int:
    """The most rounds that declarations can take: one for each node whose products some other node waits for, and one more."""
    feeds = [x for x in nodes if any(types.matches(leaf, d) for p in getattr(x, "produces", ()) for leaf in types.leaves(p) for y in nodes for d in y.depends_on)]
    return len(feeds) + 1
