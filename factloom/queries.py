"""The library's queries over the driver's tables.

``events`` become facts: user is the session, user modulo 4 the namespace, event type the type, ``floor(value / 10)`` the value. Arrival order
is ``event_id * 7919 mod 1000003``, which has nothing to do with time, and ``event_id mod 10`` is the batch.
"""

from __future__ import annotations

import contextlib
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import facts as ops
from factloom import introspection
from factloom.engine import Engine
from factloom.errors import VersionConflictError
from factloom.flow import Flow
from factloom.functions import sealing
from factloom.lite import events_of
from factloom.manager import Manager
from factloom.operators.activation import Activator
from factloom.operators.base import Aggregator, Capability, Context, Operator, OperatorPolicy, RerunOn, RetryPolicy, RowOperator
from factloom.plans import completion, graph, readiness, scheduling
from factloom.sources import archive, audit, control, durable, inbox
from factloom.sources.workspace import local, materialize, shared_dir
from factloom.streaming.ingest import StreamingStore
from factloom.types import TypeConfig, TypeRegistry

T0 = datetime(2026, 1, 1)
IDENTITY = ["session_id", "type", "value_key"]


def event_types() -> TypeRegistry:
    types = TypeRegistry()
    types.define("conversion", abstract=True)
    types.define("engagement", abstract=True)
    types.define("signup", "conversion", config=TypeConfig(pii=True), value="bigint")
    types.define("purchase", "conversion", config=TypeConfig(), value="bigint")
    types.define("view", "engagement", config=TypeConfig(ephemeral=True), value="bigint")
    types.define("click", "engagement", config=TypeConfig(), value="bigint")
    types.define("error", config=TypeConfig(audit_every_emission=True), value="bigint")
    types.define("noise", config=TypeConfig(ephemeral=True), value="bigint")
    return types


TYPES = event_types()


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as they arrive, with the batch; ``value_key`` is the plain number, which is canonical for integers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.floor(F.col("value") / 10).cast("bigint").cast("string")
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), (F.col("user_id") % 4).cast("string").alias("namespace_id"), F.col("event_type").alias("type"), v.alias("value"), v.alias("value_key"),
        F.concat(F.lit("src_"), (F.col("event_id") % 3).cast("string")).alias("retrieved_by"), F.col("ts").alias("first_retrieved"), F.col("ts").alias("last_retrieved"),
        (F.col("event_id") * 7919 % 1000003).alias("ins_seq"), (F.col("event_id") % 10).alias("batch"), "event_id",
    )


FACTS = """f AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(user_id % 4 AS VARCHAR) AS namespace_id, event_type AS type,
    CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS value_key, 'src_' || CAST(event_id % 3 AS VARCHAR) AS retrieved_by,
    ts, (event_id * 7919) % 1000003 AS seq, event_id % 10 AS batch, event_id FROM events
)"""
MERGED = FACTS + """, m AS (
  SELECT session_id, type, value_key, arg_min(namespace_id, seq) AS namespace_id, arg_min(retrieved_by, seq) AS retrieved_by,
    arg_min(ts, seq) AS first_retrieved, max(ts) AS last_retrieved, min(seq) AS ins_seq FROM f GROUP BY ALL
)"""
STAMPED = FACTS + """, pb AS (SELECT session_id, type, value_key, batch, max(ts) AS last FROM f GROUP BY ALL),
r AS (SELECT *, max(last) OVER (PARTITION BY session_id, type, value_key ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM pb),
st AS (SELECT session_id, type, value_key, min(batch) AS added_rev, max(CASE WHEN best IS NULL OR last > best THEN batch END) AS updated_rev FROM r GROUP BY ALL)"""

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _base(spark, name):
    """A folder of one query's own."""
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def _in_turn(facts, place="ins_seq"):
    """Facts no two of which arrive at once: events that share their place come by id. The place is kept whatever the ids; these stay from 0 to 2 to the power of 40."""
    return facts.withColumn(place, F.col(place) * (1 << 40) + F.pmod("event_id", F.lit(1 << 40)))


def _place(turn):
    """The place in the order of arrival that :func:`_in_turn` made a turn of."""
    return F.shiftright(turn, 40).alias("seq")


def _merged(spark, sf_dir):
    return ops.merge(_in_turn(event_facts(spark, sf_dir)).drop("batch", "event_id"))


@query(f"WITH {MERGED}, l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_retrieved DESC, ins_seq) AS n FROM m) "
       "SELECT m.session_id, min(m.namespace_id) AS namespace_id, count(*) AS n_facts, count(DISTINCT m.type) AS n_types, sum(CASE WHEN m.type IN ('signup', 'purchase') THEN 1 ELSE 0 END)::BIGINT AS n_conversion, "
       "max(CASE WHEN l.n = 1 THEN l.type END) AS latest_type, max(CASE WHEN l.n = 1 THEN l.value_key END) AS latest_value, max(m.last_retrieved) AS last_seen "
       "FROM m JOIN l ON m.session_id = l.session_id AND m.type = l.type AND m.value_key = l.value_key GROUP BY m.session_id")  # fmt: skip
def flagship_session_report(spark, sf_dir):
    """Keyed merge, latest fact and a report of each session."""
    merged = _merged(spark, sf_dir)
    newest = F.max_by(F.struct("type", "value_key"), F.struct("last_retrieved", (-F.col("ins_seq")).alias("first")))
    out = merged.groupBy("session_id").agg(F.min("namespace_id").alias("namespace_id"), F.count(F.lit(1)).alias("n_facts"), F.count_distinct("type").alias("n_types"), F.count_if(F.col("type").isin(TYPES.leaves("conversion"))).alias("n_conversion"), newest.alias("_l"), F.max("last_retrieved").alias("last_seen"))
    return out.select("session_id", "namespace_id", "n_facts", "n_types", "n_conversion", F.col("_l.type").alias("latest_type"), F.col("_l.value_key").alias("latest_value"), "last_seen")


@query(f"WITH {MERGED} SELECT session_id, type, value_key, retrieved_by, first_retrieved, last_retrieved FROM m")
def keyed_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select(*IDENTITY, "retrieved_by", "first_retrieved", "last_retrieved")


@query(f"WITH {FACTS} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY session_id, type, value_key ORDER BY seq) = 1 THEN 'ADDED' ELSE 'UPDATED' END AS outcome FROM f")
def merge_outcomes(spark, sf_dir):
    return ops.outcomes(_in_turn(event_facts(spark, sf_dir))).select("event_id", "outcome")


@query(f"WITH {FACTS} SELECT event_id, session_id, type FROM f WHERE type IN ('signup', 'purchase')")
def of_type_abstract(spark, sf_dir):
    return ops.of_type(event_facts(spark, sf_dir), TYPES, "conversion").select("event_id", "session_id", "type")


@query(f"WITH {MERGED}, l AS (SELECT *, row_number() OVER (PARTITION BY session_id, type ORDER BY last_retrieved DESC, ins_seq) AS n FROM m) SELECT session_id, type, value_key, last_retrieved FROM l WHERE n = 1")
def latest_per_type(spark, sf_dir):
    return ops.latest(_merged(spark, sf_dir), "type").select("session_id", "type", "value_key", "last_retrieved")


@query(f"WITH {MERGED}, l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_retrieved DESC, ins_seq) AS n FROM m WHERE type IN ('view', 'click')) SELECT session_id, type, value_key, last_retrieved FROM l WHERE n = 1")
def latest_per_group(spark, sf_dir):
    return ops.latest(ops.of_type(_merged(spark, sf_dir), TYPES, "engagement")).select("session_id", "type", "value_key", "last_retrieved")


@query(f"WITH {STAMPED} SELECT session_id, type, value_key, added_rev, updated_rev, CASE WHEN added_rev > 5 THEN 'added' ELSE 'updated' END AS change FROM st WHERE added_rev > 5 OR updated_rev > 5")
def delta_since(spark, sf_dir):
    return ops.change_set_since(ops.stamp_batches(event_facts(spark, sf_dir), "batch"), 5)


@query(f"WITH {STAMPED} SELECT session_id, type, value_key, 'added' AS change, true AS is_first_invocation FROM st WHERE CAST(session_id AS BIGINT) % 2 = 1 UNION ALL "
       "SELECT session_id, type, value_key, CASE WHEN added_rev > 7 THEN 'added' ELSE 'updated' END, false FROM st WHERE CAST(session_id AS BIGINT) % 2 = 0 AND (added_rev > 7 OR updated_rev > 7)")  # fmt: skip
def first_invocation_delta(spark, sf_dir):
    """Odd sessions never ran the operator: all is added. Even ones ran at revision 7."""
    state = ops.stamp_batches(event_facts(spark, sf_dir), "batch")
    marks = state.select("session_id").distinct().filter(F.col("session_id").cast("bigint") % 2 == 0).withColumn("watermark", F.lit(7).cast("bigint"))
    return ops.operator_delta(state, marks).select(*IDENTITY, "change", "is_first_invocation")


@query(f"WITH {STAMPED}, b AS (SELECT DISTINCT session_id, batch FROM r WHERE best IS NULL OR last > best) SELECT session_id, count(*) AS revision FROM b GROUP BY 1")
def revision_allocation(spark, sf_dir):
    """Each batch that changed something of a session is one revision of it."""
    state = local(spark, [], "session_id string, namespace_id string, type string, value string, value_key string, retrieved_by string, first_retrieved timestamp_ntz, last_retrieved timestamp_ntz, added_rev bigint, updated_rev bigint, ins_seq bigint")
    facts = materialize(event_facts(spark, sf_dir), "batches")
    for b in range(10):
        state = materialize(ops.apply_batch(state, facts.filter(F.col("batch") == b).drop("batch", "event_id"), ops.revisions(state)), "state")
    return ops.revisions(state)


@query(f"WITH {FACTS} SELECT DISTINCT session_id, type FROM f")
def present_types(spark, sf_dir):
    return ops.present_types(event_facts(spark, sf_dir))


@query(f"WITH {FACTS} SELECT f.event_id FROM f WHERE EXISTS (SELECT 1 FROM f g WHERE g.batch = 0 AND g.session_id = f.session_id AND g.type = f.type AND g.value_key = f.value_key)")
def identity_membership(spark, sf_dir):
    facts = event_facts(spark, sf_dir)
    return ops.contains(facts, facts.filter("batch = 0")).select("event_id")


NEEDS = [("op_any", ()), ("op_conv", ("conversion",)), ("op_error", ("error",)), ("op_full", ("conversion", "engagement", "error")), ("op_sign_click", ("signup", "click"))]
NEEDS_SQL = "n(operator_id, wanted) AS (VALUES " + ", ".join(f"('{o}', '{w}')" for o, ws in NEEDS for w in ws) + ")"
LINEAGE_SQL = "lin(leaf, wanted) AS (VALUES " + ", ".join(f"('{x}', '{a}')" for x in TYPES.names() if not TYPES[x].abstract for a in sorted(TYPES.ancestors(x))) + ")"
#: All events, but those of a value under 120 are noise: over all values every session has every type.
GRADED = FACTS + ", g AS (SELECT * REPLACE (CASE WHEN CAST(value_key AS BIGINT) >= 12 THEN type ELSE 'noise' END AS type) FROM f)"


def _graded(spark, sf_dir):
    return event_facts(spark, sf_dir).withColumn("type", F.when(F.col("value").cast("bigint") >= 12, F.col("type")).otherwise("noise"))


def _needs(spark):
    return local(spark, [(o, w) for o, ws in NEEDS for w in ws], "operator_id string, wanted string"), local(spark, [(o,) for o, _ in NEEDS], "operator_id string")


@query(f"WITH {GRADED}, {NEEDS_SQL}, {LINEAGE_SQL}, h AS (SELECT DISTINCT session_id, wanted FROM g JOIN lin ON g.type = lin.leaf), "
       "k AS (SELECT operator_id, count(*) AS c FROM n GROUP BY 1) SELECT session_id, n.operator_id FROM h JOIN n USING (wanted) JOIN k ON k.operator_id = n.operator_id GROUP BY session_id, n.operator_id, c HAVING count(*) = c UNION ALL SELECT DISTINCT session_id, 'op_any' FROM g")  # fmt: skip
def ready_operators(spark, sf_dir):
    facts = _graded(spark, sf_dir)
    wants, ids = _needs(spark)
    return readiness.ready(facts.select("session_id"), readiness.present_ancestors(facts, TYPES), wants, ids)


@query(f"WITH {GRADED}, {NEEDS_SQL}, {LINEAGE_SQL} SELECT s.session_id, n.operator_id, n.wanted AS missing FROM (SELECT DISTINCT session_id FROM g) s, n "
       "WHERE NOT EXISTS (SELECT 1 FROM g JOIN lin ON g.type = lin.leaf WHERE g.session_id = s.session_id AND lin.wanted = n.wanted)")  # fmt: skip
def readiness_gap(spark, sf_dir):
    facts = _graded(spark, sf_dir)
    return readiness.readiness_gap(facts.select("session_id"), readiness.present_ancestors(facts, TYPES), _needs(spark)[0])


def _rerun(spark, sf_dir, added_only):
    delta = ops.change_set_since(ops.stamp_batches(event_facts(spark, sf_dir), "batch"), 8)
    rows = [(o, w, added_only) for o, ws in NEEDS for w in ws]
    every = delta.withColumn("operator_id", F.explode(F.array(*[F.lit(o) for o, _ in NEEDS])))
    return readiness.relevant_new_data(every, TYPES, local(spark, rows, "operator_id string, wanted string, added_only boolean"))


RERUN_SQL = f"WITH {STAMPED}, {NEEDS_SQL}, {LINEAGE_SQL} SELECT DISTINCT session_id, operator_id FROM st JOIN lin ON st.type = lin.leaf JOIN n ON n.wanted = lin.wanted WHERE added_rev > 8"


@query(RERUN_SQL)
def rerun_triggers_added_only(spark, sf_dir):
    return _rerun(spark, sf_dir, True)


@query(RERUN_SQL + " OR updated_rev > 8")
def rerun_triggers_any(spark, sf_dir):
    return _rerun(spark, sf_dir, False)


@query(f"WITH {GRADED} SELECT session_id, (bool_or(type IN ('signup', 'purchase')) AND (bool_or(type = 'error') OR bool_or(type = 'click'))) AS satisfied FROM g GROUP BY 1")
def completion_all_any(spark, sf_dir):
    facts = _graded(spark, sf_dir)
    return completion.satisfied(facts, facts.select("session_id"), completion.all_of("conversion", completion.any_of("error", "click")), TYPES)


class Net(Capability):
    capability_id = "cap_net"
    kinds = ("network",)
    depends_on = ("engagement",)


class Geo(Capability):
    capability_id = "cap_geo"
    kinds = ("lookup",)
    requires = ("network",)
    depends_on = ("purchase",)


class Lookup(Capability):
    capability_id = "cap_alt"
    kinds = ("lookup", "backup")


class Deep(Capability):
    capability_id = "cap_deep"
    kinds = ("deep",)
    requires = ("lookup", "network")


CAPS = (Net(), Geo(), Lookup(), Deep())
AVAILABLE_SQL = f"""WITH {GRADED}, s AS (SELECT DISTINCT session_id, namespace_id FROM g),
net AS (SELECT DISTINCT session_id FROM g WHERE type IN ('view', 'click')), geo AS (SELECT DISTINCT session_id FROM g JOIN net USING (session_id) WHERE type = 'purchase'),
av AS (SELECT session_id, 'cap_net' AS capability_id FROM net UNION ALL SELECT session_id, 'cap_geo' FROM geo UNION ALL SELECT session_id, 'cap_alt' FROM s UNION ALL SELECT session_id, 'cap_deep' FROM net)"""


def _available(spark, facts):
    return readiness.available_capabilities(facts.select("session_id"), readiness.present_ancestors(facts, TYPES), spark, CAPS)


@query(AVAILABLE_SQL + " SELECT * FROM av")
def capability_available(spark, sf_dir):
    return _available(spark, _graded(spark, sf_dir))


@query(AVAILABLE_SQL + ", k(capability_id, kind) AS (VALUES ('cap_net', 'network'), ('cap_geo', 'lookup'), ('cap_alt', 'lookup'), ('cap_alt', 'backup'), ('cap_deep', 'deep')) "
       "SELECT session_id, kind, capability_id, CAST(row_number() OVER (PARTITION BY session_id, kind ORDER BY CASE WHEN namespace_id IN ('1', '3') AND capability_id = 'cap_geo' THEN 0 ELSE 2147483647 END, capability_id) AS INTEGER) AS rank FROM av JOIN k USING (capability_id) JOIN s USING (session_id)")  # fmt: skip
def provider_resolution(spark, sf_dir):
    """Namespaces 1 and 3 prefer cap_geo."""
    facts = _graded(spark, sf_dir)
    kinds = local(spark, [(c.capability_id, k) for c in CAPS for k in c.kinds], "capability_id string, kind string")
    catalog = control.Catalog(preferred={"1": ("cap_geo",), "3": ("cap_geo",)})
    preferred = facts.select("session_id", "namespace_id").distinct().join(F.broadcast(catalog.preferences(spark)), "namespace_id").drop("namespace_id")
    return readiness.resolve_providers(_available(spark, facts), kinds, preferred)


@query(f"WITH {FACTS}, p AS (SELECT DISTINCT namespace_id FROM f), o(operator_id) AS (VALUES ('op_any'), ('op_conv'), ('op_error'), ('op_full'), ('op_sign_click')) "
       "SELECT namespace_id, operator_id FROM p, o WHERE namespace_id = '0' OR (namespace_id = '1' AND operator_id IN ('op_any', 'op_error'))")  # fmt: skip
def operator_gating(spark, sf_dir):
    """Namespace 0 permits all, 1 two operators, 2 none, 3 is not in the catalog."""
    pairs = event_facts(spark, sf_dir).select("namespace_id").distinct().withColumn("operator_id", F.explode(F.array(*[F.lit(o) for o, _ in NEEDS])))
    grants = control.Catalog(operators={"0": None, "1": {"op_any", "op_error"}, "2": set()}).grants(spark, "operators", "operator_id")
    return readiness.permitted_operators(pairs, grants)


def _chain_types() -> TypeRegistry:
    types = event_types()
    for name in ("tally", "risk", "alert", "pulse"):
        types.define(name, config=TypeConfig(), value="bigint")
    return types


class Tally(Operator):
    """How many purchases a session has, once it has any."""

    operator_id = "op_tally"
    policy = OperatorPolicy(rerun_on_new_data=False)
    depends_on, produces = ("purchase",), ("tally",)

    def transform(self, ctx: Context) -> DataFrame:
        return ctx.of_type("purchase").groupBy("session_id").agg(F.count(F.lit(1)).cast("string").alias("value")).withColumn("type", F.lit("tally"))


class Risk(Operator):
    """Errors for each session with a tally."""

    operator_id = "op_risk"
    policy = OperatorPolicy(rerun_on_new_data=False)
    depends_on, produces = ("tally", "error"), ("risk",)

    def transform(self, ctx: Context) -> DataFrame:
        n = ctx.of_type("error").groupBy("session_id").agg(F.count(F.lit(1)).alias("e"))
        return ctx.latest("tally").join(n, "session_id").select("session_id", F.lit("risk").alias("type"), (F.col("e") * 10 + F.col("value").cast("bigint")).cast("string").alias("value"))


class Alert(Operator):
    """The sum of all risks above 30; runs again when a risk is added."""

    operator_id = "op_alert"
    policy = OperatorPolicy(rerun_on_new_data=True, rerun_on=RerunOn.ADDED_ONLY)
    depends_on, produces = ("risk",), ("alert",)

    def transform(self, ctx: Context) -> DataFrame:
        return ctx.latest("risk").filter(F.col("value").cast("bigint") > 30).select("session_id", F.lit("alert").alias("type"), "value")


class Report(Aggregator):
    operator_id = "agg_report"
    policy = OperatorPolicy(rerun_on_new_data=False)
    depends_on, consumes = ("risk",), ("alert",)

    def aggregate(self, ctx: Context) -> DataFrame:
        n = ctx.store.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
        return n.select("session_id", F.lit("reports").alias("table"), F.col("session_id").alias("key"), F.to_json(F.struct("n")).alias("document"))


def _seed(spark, sf_dir):
    return _graded(spark, sf_dir).drop("batch", "event_id", "value_key")


CHAIN_SQL = f"""WITH {GRADED}, d AS (SELECT DISTINCT session_id, type, value_key FROM g),
ta AS (SELECT session_id, 'tally' AS type, count(*) AS v FROM d WHERE type = 'purchase' GROUP BY 1),
ri AS (SELECT ta.session_id, 'risk' AS type, count(*) * 10 + min(ta.v) AS v FROM ta JOIN d ON d.session_id = ta.session_id AND d.type = 'error' GROUP BY 1),
al AS (SELECT session_id, 'alert' AS type, v FROM ri WHERE v > 30),
ch AS (SELECT session_id, type, CAST(v AS VARCHAR) AS value FROM ta UNION ALL SELECT session_id, type, CAST(v AS VARCHAR) FROM ri UNION ALL SELECT session_id, type, CAST(v AS VARCHAR) FROM al)"""


def _chain(spark, sf_dir):
    flow = Flow("chain", _chain_types(), [Tally, Risk, Alert])
    return Engine(spark).run(flow, _seed(spark, sf_dir), now=T0)


@query(CHAIN_SQL + " SELECT * FROM ch")
def superstep_fixpoint(spark, sf_dir):
    """A chain of three operators run to quiescence."""
    return _chain(spark, sf_dir).facts.filter("type in ('tally', 'risk', 'alert')").select("session_id", "type", "value")


@query(CHAIN_SQL + ", ra AS (SELECT session_id, 'op_tally' AS operator_id FROM ta UNION ALL SELECT session_id, 'op_risk' FROM ri UNION ALL SELECT session_id, 'op_alert' FROM ri) SELECT session_id, operator_id, 1::BIGINT AS runs FROM ra")
def operator_runs(spark, sf_dir):
    """Attempts of each operator in each session, from the run log."""
    return _chain(spark, sf_dir).runs.groupBy("session_id", "operator_id").agg(F.count(F.lit(1)).alias("runs"))


class Pulse(Operator):
    """Feeds itself; only its bound ends it."""

    operator_id = "op_pulse"
    policy = OperatorPolicy(rerun_on_new_data=True, max_cycles=3)
    depends_on, produces = ("purchase",), ("pulse", "purchase")
    uses = ("pulse",)

    def transform(self, ctx: Context) -> DataFrame:
        last = ctx.store.filter("type = 'pulse'").groupBy("session_id").agg(F.max(F.col("value").cast("bigint")).alias("v"))
        return ctx.sessions.join(last, "session_id", "left").select("session_id", F.lit("pulse").alias("type"), (F.coalesce("v", F.lit(0)) + 1).cast("string").alias("value"))


@query(f"WITH {GRADED}, s AS (SELECT DISTINCT session_id FROM g WHERE type = 'purchase') SELECT session_id, CAST(v AS VARCHAR) AS value FROM s, (VALUES (1), (2), (3)) AS t(v)")
def bounded_cycle(spark, sf_dir):
    flow = Flow("cycle", _chain_types(), [Pulse])
    return Engine(spark).run(flow, _seed(spark, sf_dir), now=T0).facts.filter("type = 'pulse'").select("session_id", "value")


@query(CHAIN_SQL + ", n AS (SELECT session_id, count(*) AS n FROM (SELECT session_id, type, value_key FROM d UNION ALL SELECT * FROM ch) GROUP BY 1) "
       "SELECT ri.session_id AS key, '{\"n\":' || CAST(n.n AS VARCHAR) || '}' AS document, 1::BIGINT AS version, 'final' AS status FROM ri JOIN n USING (session_id)")  # fmt: skip
def aggregated_documents(spark, sf_dir):
    """The flow with its aggregator: one final document for each session that has a risk."""
    base = _base(spark, "engine")
    flow = Flow("report", _chain_types(), [Tally, Risk, Alert], [Report])
    docs = Engine(spark, base).run(flow, _seed(spark, sf_dir), now=T0).documents
    return docs.select("key", "document", "version", "status")


class Idle(Operator):
    """Nobody reads what it makes."""

    operator_id = "op_idle"
    policy = OperatorPolicy(rerun_on_new_data=False)
    depends_on, produces = ("alert",), ("pulse",)

    def transform(self, ctx: Context) -> DataFrame:
        return ctx.latest("alert").select("session_id", F.lit("pulse").alias("type"), F.lit("0").alias("value"))


def _graph_nodes():
    return [Tally(), Risk(), Alert(), Report(), *CAPS]


@query("SELECT * FROM (VALUES ('op_tally', 'op_risk'), ('op_risk', 'op_alert'), ('op_risk', 'agg_report'), ('cap_net', 'cap_geo'), ('cap_net', 'cap_deep'), ('cap_geo', 'cap_deep'), ('cap_alt', 'cap_deep')) AS t(src, dst)")
def graph_edges(spark, sf_dir):
    return graph.frames(spark, graph.build_edges(_graph_nodes(), _chain_types()))[1]


@query("WITH RECURSIVE e(src, dst) AS (VALUES ('op_tally', 'op_risk'), ('op_risk', 'op_alert')), b(node) AS (SELECT 'op_alert' UNION SELECT src FROM e JOIN b ON dst = node) SELECT node FROM b")
def backward_reachable(spark, sf_dir):
    """What the alert needs; an operator that nobody consumes is pruned."""
    kept = graph.backward_reachable([Tally(), Risk(), Alert(), Idle()], _chain_types(), ["alert"])
    return local(spark, [(x,) for x in sorted(kept)], "node string")


@query(f"WITH {FACTS} SELECT namespace_id AS key, type AS field, count(DISTINCT session_id) AS cardinality FROM f GROUP BY ALL")
def add_to_set_cardinality(spark, sf_dir):
    members = event_facts(spark, sf_dir).select(F.col("namespace_id").alias("key"), F.col("type").alias("field"), F.col("session_id").alias("member"))
    return durable.set_cardinality(members, "key", "field")


def _writes(spark, sf_dir):
    """Writes by session: the epoch goes up with every 100 events but now and then falls back."""
    epoch = (F.col("event_id") / 100).cast("bigint") - F.when(F.col("event_id") % 7 == 0, 2).otherwise(0)
    return event_facts(spark, sf_dir).select("session_id", "event_id", epoch.alias("epoch"))


WRITES = FACTS + """, w AS (SELECT session_id, event_id, CAST(event_id // 100 AS BIGINT) - CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS epoch FROM f),
a AS (SELECT *, coalesce(epoch >= max(epoch) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM w)"""


@query(f"WITH {WRITES} SELECT session_id, event_id, epoch, accepted FROM a")
def fenced_writes(spark, sf_dir):
    return durable.accepted(_writes(spark, sf_dir), ("session_id",), order="event_id")


@query(f"WITH {WRITES} SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS version FROM a WHERE accepted")
def occ_upsert_versions(spark, sf_dir):
    return durable.versions(_writes(spark, sf_dir), ("session_id",), order="event_id").select("session_id", "event_id", "version")


def _documents(facts, status):
    return facts.groupBy(F.col("session_id").alias("key")).agg(F.max("value_key").alias("document")).select(F.lit("t").alias("table_name"), "key", "document", F.lit(status).alias("status"), F.lit(T0).cast("timestamp_ntz").alias("updated_at"), F.lit(1).cast("bigint").alias("epoch"), F.lit(0).cast("bigint").alias("version"))


@query(f"WITH {FACTS}, x AS (SELECT session_id || type AS key, max(value_key) AS document FROM f WHERE batch < 2 GROUP BY 1), y AS (SELECT session_id || type AS key, max(value_key) AS document FROM f WHERE batch >= 2 GROUP BY 1) "
       "SELECT coalesce(x.key, y.key) AS key, coalesce(x.document, y.document) AS document, CASE WHEN x.key IS NOT NULL THEN 'final' ELSE 'in_progress' END AS status, 1::BIGINT AS version FROM x FULL JOIN y ON x.key = y.key")  # fmt: skip
def interim_never_downgrades(spark, sf_dir):
    """Final documents of the first two batches, then interim ones of the others: the final ones stay at their version."""
    facts = event_facts(spark, sf_dir).withColumn("session_id", F.concat("session_id", "type"))
    stored = durable.settle(local(spark, [], durable.DOCUMENT_DDL), _documents(facts.filter("batch < 2"), durable.FINAL))
    return durable.settle(stored, _documents(facts.filter("batch >= 2"), durable.INTERIM)).select("key", "document", "status", "version")


@query(f"WITH {FACTS}, k AS (SELECT DISTINCT session_id, type AS operator_id FROM f WHERE batch < 5 AND value_key > '5') SELECT DISTINCT session_id, type AS operator_id, 2::BIGINT AS epoch FROM f "
       "WHERE batch >= 5 AND NOT EXISTS (SELECT 1 FROM k WHERE k.session_id = f.session_id AND k.operator_id = f.type) UNION ALL SELECT session_id, operator_id, 1 FROM k")  # fmt: skip
def contribution_once(spark, sf_dir):
    """The store's marks after early contributions under epoch 1 and late ones under epoch 2: each pair has one mark, the first."""
    facts = event_facts(spark, sf_dir).select("session_id", F.col("type").alias("operator_id"), "batch", "value_key")
    store = durable.DurableStore(spark, _base(spark, "marks"))
    store.mark_contributions(facts.filter("batch < 5 and value_key > '5'"), 1)
    store.mark_contributions(facts.filter("batch >= 5"), 2)
    return store.marks.read()


def _archive_rows(facts):
    kept = archive.durable_only(facts, TYPES)
    return kept.select("namespace_id", "session_id", "type", sealing.value_hash(F.col("value_key")).alias("value_hash"), "value", F.lit(False).alias("sealed"), "retrieved_by", "first_retrieved", "last_retrieved", F.col("batch").alias("epoch"), "ins_seq")


ARCHIVE_SQL = f"WITH {FACTS} SELECT session_id, type, sha256(value_key) AS value_hash, arg_min(retrieved_by, seq) AS retrieved_by, arg_min(ts, seq) AS first_retrieved, max(ts) AS last_retrieved, max(batch) AS epoch FROM f WHERE type <> 'view' GROUP BY ALL"


@query(ARCHIVE_SQL)
def archive_fold(spark, sf_dir):
    return archive.fold(_archive_rows(event_facts(spark, sf_dir))).select("session_id", "type", "value_hash", "retrieved_by", "first_retrieved", "last_retrieved", "epoch")


KEYS = {str(n): bytes([65 + n]) * 16 for n in range(4)}
ARCHIVED = f"WITH {FACTS} SELECT namespace_id, session_id, type, value_key AS value, arg_min(retrieved_by, seq) AS retrieved_by, arg_min(ts, seq) AS first_retrieved, max(ts) AS last_retrieved, max(CASE WHEN batch < 5 THEN 1 ELSE 2 END)::BIGINT AS epoch FROM f WHERE type <> 'view' GROUP BY session_id, namespace_id, type, value_key"


def _vault(spark, sf_dir, retention=None):
    """An archive with half of the events flushed and half still buffered; sign-ups are personal data."""
    vault = archive.Archive(spark, _base(spark, "archive"), TYPES, sealing.CipherProvider(KEYS), retention)
    facts = event_facts(spark, sf_dir)
    for epoch, half in ((1, "batch < 5"), (2, "batch >= 5")):
        vault.archive(facts.filter(half).drop("batch", "event_id"), epoch)
        if epoch == 1:
            vault.flush(epoch)
    return vault


@query(ARCHIVED)
def archive_read_through_buffer(spark, sf_dir):
    """A read sees flushed and buffered rows alike, opened; ephemeral types are not there."""
    return _vault(spark, sf_dir).read().select("namespace_id", "session_id", "type", "value", "retrieved_by", "first_retrieved", "last_retrieved", "epoch")


@query(ARCHIVED.replace("value_key AS value", "CASE WHEN type = 'signup' THEN NULL ELSE value_key END AS value").replace("GROUP BY session_id, namespace_id, type, value_key", "GROUP BY session_id, namespace_id, type, value_key HAVING max(ts) + INTERVAL 7 DAY >= TIMESTAMP '2024-01-25'"))
def archive_retention(spark, sf_dir):
    """Sealed rows within seven days of 25 January: personal values cannot be read, others can."""
    rows = _vault(spark, sf_dir, timedelta(days=7)).read(F.lit(datetime(2024, 1, 25)).cast("timestamp_ntz"), unseal=False)
    value = F.when(~F.col("sealed"), F.col("value"))
    return rows.select("namespace_id", "session_id", "type", value.alias("value"), "retrieved_by", "first_retrieved", "last_retrieved", "epoch")


@query(f"WITH {FACTS}, k AS (SELECT session_id, type, value_key FROM f WHERE type <> 'view' AND batch >= 5 GROUP BY ALL), a AS (SELECT session_id, type, value_key FROM f WHERE type <> 'view' GROUP BY ALL) "
       "SELECT (SELECT count(*) FROM f WHERE type <> 'view' AND batch >= 5) AS buffered, (SELECT count(*) FROM f WHERE type <> 'view' AND batch >= 5) AS flushed, 0::BIGINT AS left_over, (SELECT count(*) FROM a) AS stored, (SELECT count(*) FROM a WHERE type = 'signup') AS sealed")  # fmt: skip
def archive_flush(spark, sf_dir):
    """How much is buffered before and after a flush, and what is stored then."""
    vault = _vault(spark, sf_dir)
    buffered = vault.buffered_count()
    flushed = vault.flush(2)
    return vault.table.read().agg(F.lit(buffered).cast("bigint").alias("buffered"), F.lit(flushed).cast("bigint").alias("flushed"), F.lit(vault.buffered_count()).cast("bigint").alias("left_over"), F.count(F.lit(1)).alias("stored"), F.count_if("sealed").alias("sealed"))


@query(f"WITH {FACTS}, o AS (SELECT session_id, type, CASE WHEN row_number() OVER (PARTITION BY session_id, type, value_key ORDER BY seq) = 1 THEN 'ADDED' ELSE 'UPDATED' END AS outcome FROM f) "
       "SELECT session_id, type, CASE WHEN outcome = 'UPDATED' THEN 're-observed' ELSE 'merged' END AS reason, count(*) AS n FROM o WHERE type <> 'error' AND (outcome = 'UPDATED' OR type = 'view') GROUP BY ALL")  # fmt: skip
def audit_coalesced_counts(spark, sf_dir):
    return audit.coalesced_counts(ops.outcomes(event_facts(spark, sf_dir)), TYPES)


@query(f"WITH {FACTS} SELECT event_id, CASE WHEN type = 'signup' THEN '<redacted>' ELSE value_key END AS summary FROM f")
def audit_redaction(spark, sf_dir):
    return event_facts(spark, sf_dir).select("event_id", sealing.audit_summary(TYPES).alias("summary"))


@query(f"WITH {FACTS}, e AS (SELECT session_id, type, coalesce(retrieved_by, '') AS who, value_key, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS sequence FROM f) SELECT session_id, sequence, type, value_key FROM e")
def audit_sequence(spark, sf_dir):
    """Contiguous sequence numbers for each session."""
    facts = _in_turn(event_facts(spark, sf_dir))
    return audit.allocate(facts, local(spark, [], "session_id string, last bigint"), "ins_seq").select("session_id", "sequence", "type", "value_key")


def _wire(spark, sf_dir):
    """Payloads as producers send them; every eleventh is cut short, every thirteenth has no type."""
    e = event_facts(spark, sf_dir)
    whole = F.concat(F.lit('{"type":"'), F.col("type"), F.lit('","value":'), F.col("value"), F.lit("}"))
    payload = F.when(F.col("event_id") % 11 == 0, F.substring(whole, 1, 9)).when(F.col("event_id") % 13 == 0, F.lit('{"value":1}')).otherwise(whole)
    return e.select("event_id", "session_id", F.col("ins_seq").alias("seq"), payload.alias("payload"))


@query(f"WITH {FACTS} SELECT event_id, (event_id % 11 = 0 OR event_id % 13 = 0) AS poison FROM f")
def inbox_poison_split(spark, sf_dir):
    good, bad = inbox.split_poison(_wire(spark, sf_dir))
    return good.select("event_id", F.lit(False).alias("poison")).unionByName(bad.select("event_id", F.lit(True).alias("poison")))


def _sent(spark, sf_dir, what="inbox"):
    """An inbox that holds all events as producers sent them, each in its turn; every seventeenth is of a type that nobody here knows."""
    box = inbox.Inbox(spark, _base(spark, what))
    rows = _wire(spark, sf_dir).withColumn("payload", F.when(F.col("event_id") % 17 == 0, F.lit('{"type":"from_a_newer_deploy","value":1}')).otherwise(F.col("payload")))
    box.append(_in_turn(rows, "seq").select("session_id", "payload", "seq"))
    return box


#: kind of every sent entry: poison is cut short or has no type, unknown cannot be applied yet.
SENT = FACTS + """, w AS (SELECT session_id, seq, type, value_key, CASE WHEN event_id % 17 = 0 THEN 'unknown' WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'poison' ELSE 'good' END AS kind,
row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM f)"""


@query(f"WITH {SENT} SELECT session_id, seq, type, value_key FROM w WHERE kind = 'good'")
def inbox_drain(spark, sf_dir):
    """What one drain gives: every good entry as a fact; poison and entries of unknown types hold up none of them."""
    facts = _sent(spark, sf_dir).drain(TYPES, 1)
    return facts.select("session_id", _place("ins_seq"), "type", F.col("value").alias("value_key"))


@query(f"WITH {SENT} SELECT session_id, seq, 1 AS delivery_count FROM w WHERE n <= 3")
def inbox_bounded_consume(spark, sf_dir):
    """The first three entries of each session in order of arrival, claimed by the inbox."""
    return _sent(spark, sf_dir).consume(1, 3).select("session_id", _place("seq"), "delivery_count")


@query(f"WITH {SENT} SELECT session_id, seq, 2 AS delivery_count FROM w WHERE n <= 3 AND kind <> 'good'")
def inbox_redelivery(spark, sf_dir):
    """Of three claimed entries a session the good ones are acknowledged; the others are reclaimed and counted again."""
    box = _sent(spark, sf_dir)
    claimed = materialize(box.consume(1, 3), "claimed")
    good = inbox.split_poison(claimed)[0].filter(~F.col("payload").contains("from_a_newer_deploy"))
    box.ack(good, 1)
    return box.reclaim(1).select("session_id", _place("seq"), "delivery_count")


@query(f"WITH {SENT} SELECT session_id, count(*) AS pending FROM w WHERE kind = 'unknown' GROUP BY 1")
def inbox_pending(spark, sf_dir):
    """After a drain and its acknowledgement only entries of unknown types are open."""
    box = _sent(spark, sf_dir)
    box.ack(box.drain(TYPES, 1).select("entry_id"), 1)
    return box.pending_count()


@query(f"WITH {SENT} SELECT session_id, seq, CASE WHEN kind = 'poison' THEN 'poison' ELSE 'delivered too often' END AS reason, CASE WHEN kind = 'poison' THEN 1 ELSE 3 END AS delivery_count FROM w WHERE kind <> 'good'")
def delivery_cap_quarantine(spark, sf_dir):
    """What three drains with a cap of two deliveries put into quarantine, with the reason; good entries are acknowledged at once."""
    box = _sent(spark, sf_dir)
    for _ in range(3):
        box.ack(box.drain(TYPES, 1, max_deliveries=2).select("entry_id"), 1)
    return box.quarantined().join(box.entries.read().select("entry_id", "seq"), "entry_id").select("session_id", _place("seq"), "reason", "delivery_count")


@query(f"WITH RECURSIVE {FACTS}, d AS (SELECT session_id, min(ts) + INTERVAL 6 HOUR AS due FROM f GROUP BY 1 UNION ALL "
       "SELECT d.session_id, (SELECT min(f.ts) FROM f WHERE f.session_id = d.session_id AND f.ts > d.due) + INTERVAL 6 HOUR FROM d WHERE d.due IS NOT NULL) SELECT session_id, due FROM d WHERE due IS NOT NULL")  # fmt: skip
def debounce_runs(spark, sf_dir):
    return scheduling.debounce_runs(event_facts(spark, sf_dir), "session_id", "first_retrieved", timedelta(hours=6))


@query(f"WITH RECURSIVE {FACTS}, d AS (SELECT session_id, min(ts) AS accepted_at FROM f GROUP BY 1 UNION ALL "
       "SELECT d.session_id, (SELECT min(f.ts) FROM f WHERE f.session_id = d.session_id AND f.ts >= d.accepted_at + INTERVAL 6 HOUR) FROM d WHERE d.accepted_at IS NOT NULL) SELECT session_id, accepted_at FROM d WHERE accepted_at IS NOT NULL")  # fmt: skip
def cooldown_gate(spark, sf_dir):
    return scheduling.cooldown_gate(event_facts(spark, sf_dir), "session_id", "first_retrieved", timedelta(hours=6))


@query(f"WITH {FACTS} SELECT event_id, CAST(a AS INTEGER) AS attempt, CAST(50.0 * pow(2, a - 1) AS DOUBLE) AS delay_ms FROM f, generate_series(1, 4) AS t(a) WHERE type = 'error'")
def backoff_schedule(spark, sf_dir):
    return scheduling.backoff_schedule(event_facts(spark, sf_dir).filter("type = 'error'").select("event_id"), RetryPolicy())


@query(f"WITH {FACTS} SELECT event_id, ts < min(ts) OVER (PARTITION BY session_id) + INTERVAL 10 DAY AS in_time FROM f")
def deadline_partition(spark, sf_dir):
    return scheduling.within_deadline(event_facts(spark, sf_dir), "session_id", "first_retrieved", timedelta(days=10)).select("event_id", "in_time")


@query(f"WITH {FACTS}, l AS (SELECT session_id, ts, lead(ts) OVER (PARTITION BY session_id ORDER BY ts) AS nxt FROM f) SELECT session_id, ts + INTERVAL 12 HOUR AS parked_at FROM l WHERE nxt > ts + INTERVAL 12 HOUR")
def park_points(spark, sf_dir):
    return scheduling.park_points(event_facts(spark, sf_dir), "session_id", "first_retrieved", timedelta(hours=12))


@query(f"""WITH RECURSIVE {FACTS}, k AS (SELECT session_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n FROM f),
b(session_id, n, event_id, t, a, tat) AS (SELECT session_id, n, event_id, t, t, t + 3600000000 FROM k WHERE n = 1 UNION ALL
SELECT k.session_id, k.n, k.event_id, k.t, greatest(k.t, b.a, b.tat - 7200000000), greatest(k.t, b.a, b.tat) + 3600000000 FROM b JOIN k ON k.session_id = b.session_id AND k.n = b.n + 1)
SELECT session_id, event_id, make_timestamp(t) AS requested_at, make_timestamp(a) AS admitted_at FROM b""")
def token_bucket_admission(spark, sf_dir):
    """One token an hour for each session, three at most; requests wait for a token and none fails."""
    return scheduling.token_bucket(event_facts(spark, sf_dir), "session_id", "first_retrieved", 3, 1 / 3600, "event_id")


@query(f"WITH {FACTS} SELECT session_id FROM (SELECT session_id, count(*) AS epoch, bool_or(type = 'purchase' AND batch = 0) AS complete, epoch(max(ts)) AS lease_until FROM f GROUP BY 1) WHERE epoch > 0 AND NOT complete AND lease_until < 1706650000")
def orphaned_sessions(spark, sf_dir):
    sessions = event_facts(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("epoch"), F.bool_or((F.col("type") == "purchase") & (F.col("batch") == 0)).alias("complete"), (F.unix_micros(F.max("last_retrieved").cast("timestamp")) / 1e6).alias("lease_until"))
    return control.orphaned(sessions, F.lit(1706650000.0)).select("session_id")


@query(f"WITH {MERGED} SELECT session_id, type, count(*) AS n FROM m GROUP BY ALL")
def introspection_counts(spark, sf_dir):
    return introspection.counts_by_type(_merged(spark, sf_dir))


@query(CHAIN_SQL + " SELECT 'kept' AS side, count(*) AS n FROM (SELECT session_id, type, value_key FROM d UNION ALL SELECT * FROM ch) UNION ALL SELECT 'lost', 0 UNION ALL SELECT 'new', 0")
def replay_equivalence(spark, sf_dir):
    """The run's facts archived and run again give the same facts."""
    flow = Flow("chain", _chain_types(), [Tally, Risk, Alert])
    first = Engine(spark).run(flow, _seed(spark, sf_dir), now=T0).facts
    again = introspection.replay(Engine(spark), flow, first, now=T0).facts
    a, b = first.select(*IDENTITY), again.select(*IDENTITY)
    side = lambda df, name: df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return side(b, "kept").unionByName(side(a.exceptAll(b), "lost")).unionByName(side(b.exceptAll(a), "new"))


@query(CHAIN_SQL + ", w AS (SELECT session_id, type, value_key AS value FROM d UNION ALL SELECT * FROM ch) SELECT session_id, count(*) AS n_facts, 'COMPLETED' AS status FROM w GROUP BY 1")
def lite_session_result(spark, sf_dir):
    from factloom.lite import run_session

    out = run_session(spark, Flow("chain", _chain_types(), [Tally, Risk, Alert]), _seed(spark, sf_dir), now=T0)
    ended = out.events.filter("kind = 'session_finished'").select("session_id", F.col("outcome").alias("status"))
    return out.data_points.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_facts")).join(ended, "session_id", "left")


@query(CHAIN_SQL + """, ev AS (SELECT DISTINCT session_id, 'session_started' AS kind FROM d UNION ALL SELECT DISTINCT session_id, 'session_finished' FROM d
UNION ALL SELECT session_id, 'data_point_added' FROM (SELECT session_id, type, value_key FROM d UNION ALL SELECT * FROM ch)
UNION ALL SELECT session_id, 'operator_finished' FROM ta UNION ALL SELECT session_id, 'operator_finished' FROM ri UNION ALL SELECT session_id, 'operator_finished' FROM ri)
SELECT session_id, kind, count(*) AS n FROM ev GROUP BY ALL""")
def lite_events(spark, sf_dir):
    return events_of(_chain(spark, sf_dir)).groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("n"))


class Watch(Operator):
    """Looks at a session again whenever anything new can be used there."""

    operator_id = "op_watch"
    policy = OperatorPolicy(rerun_on_new_data=True, rerun_on=RerunOn.ADDED_ONLY)
    depends_on, produces = ("engagement",), ("pulse",)

    def transform(self, ctx: Context) -> DataFrame:
        return ctx.sessions.select("session_id", F.lit("pulse").alias("type"), F.lit("1").alias("value"))


class Desk(Capability):
    capability_id = "cap_desk"
    kinds = ("desk",)
    depends_on = ("tally",)


@query(CHAIN_SQL + ", e AS (SELECT DISTINCT session_id FROM d WHERE type IN ('view', 'click')) SELECT e.session_id, 'op_watch' AS operator_id, 1 + (ta.session_id IS NOT NULL)::BIGINT AS runs FROM e LEFT JOIN ta ON e.session_id = ta.session_id UNION ALL SELECT session_id, 'op_tally', 1 FROM ta")
def capability_rerun(spark, sf_dir):
    """A tally makes a capability available, which is a reason to run again for an operator that reruns; no fact that it depends on is new."""
    out = Engine(spark).run(Flow("watch", _chain_types(), [Tally, Watch], capabilities=[Desk]), _seed(spark, sf_dir), now=T0)
    return out.op_state.select("session_id", "operator_id", "runs")


class Choose(Operator):
    """Says which provider its session would use."""

    operator_id = "op_choose"
    policy = OperatorPolicy(rerun_on_new_data=False)
    requires, produces = ("lookup",), ("note",)

    def transform(self, ctx: Context) -> DataFrame:
        return ctx.capabilities.require("lookup").select("session_id", F.lit("note").alias("type"), F.concat(F.lit('"'), "capability_id", F.lit('"')).alias("value"))


@query(AVAILABLE_SQL + ", ok AS (SELECT session_id, capability_id, namespace_id FROM av JOIN s USING (session_id) WHERE capability_id IN ('cap_geo', 'cap_alt') AND (namespace_id IN ('0', '1') OR (namespace_id = '2' AND capability_id = 'cap_geo'))) "
       "SELECT session_id, CASE WHEN bool_or(capability_id = 'cap_geo') AND min(namespace_id) <> '0' THEN 'cap_geo' ELSE min(capability_id) END AS provider FROM ok GROUP BY 1")  # fmt: skip
def gated_resolution(spark, sf_dir):
    """What an operator resolves: gated by facts and by the namespace's grants, in the namespace's order. Namespace 2 permits no cap_alt, 3 nothing."""
    types = _chain_types()
    types.define("note", config=TypeConfig())
    catalog = control.Catalog(capabilities={"0": None, "1": None, "2": {"cap_geo", "cap_net"}, "3": set()}, preferred={"1": ("cap_geo",)})
    out = Engine(spark, catalog=catalog).run(Flow("choose", types, [Choose], capabilities=CAPS), _seed(spark, sf_dir), now=T0)
    return out.facts.filter("type = 'note'").select("session_id", F.regexp_replace("value", '"', "").alias("provider"))


class Fragile(Operator):
    """Breaks over one session."""

    operator_id = "op_fragile"
    policy = OperatorPolicy(rerun_on_new_data=False)
    depends_on, produces = ("purchase",), ("pulse",)

    def transform(self, ctx: Context) -> DataFrame:
        broken = F.when(F.col("session_id") == "7", F.raise_error(F.lit("session 7 is broken")).cast("string")).otherwise(F.lit("1"))
        return ctx.sessions.select("session_id", F.lit("pulse").alias("type"), broken.alias("value"))


@query(CHAIN_SQL + " SELECT session_id, 'op_fragile' AS operator_id, CASE WHEN session_id = '7' THEN 'failed' ELSE 'succeeded' END AS outcome, CASE WHEN session_id = '7' THEN 0 ELSE 1 END::BIGINT AS emitted FROM ta")
def isolated_failures(spark, sf_dir):
    """A set-wise operator that breaks over one session fails there and succeeds elsewhere."""
    out = Engine(spark).run(Flow("fragile", _chain_types(), [Fragile]), _seed(spark, sf_dir), now=T0)
    made = out.facts.filter("type = 'pulse'").groupBy("session_id").agg(F.count(F.lit(1)).alias("emitted"))
    return out.runs.join(made, "session_id", "left").select("session_id", "operator_id", "outcome", F.coalesce("emitted", F.lit(0)).cast("bigint").alias("emitted"))


class Flaky(RowOperator):
    """Emits one fact and then fails in every third session."""

    operator_id = "op_flaky"
    policy = OperatorPolicy(rerun_on_new_data=False, retry=RetryPolicy(max_attempts=3, base=timedelta(seconds=10), jitter=0.0))
    depends_on, produces = ("purchase",), ("pulse",)

    def run(self, session_id, facts):
        yield "pulse", "1"
        if int(session_id) % 3 == 0:
            raise ValueError("flaky")
        yield "pulse", str(2 + sum(f["type"] == "purchase" for f in facts))


@query(CHAIN_SQL + """, r(bad, outcome, s) AS (VALUES (true, 'retrying', 0), (true, 'retrying', 10), (true, 'failed', 30), (false, 'succeeded', 0))
SELECT session_id, outcome, TIMESTAMP '2026-01-01' + to_seconds(s) AS at, CASE WHEN bad THEN '1' ELSE '1,' || CAST(2 + v AS VARCHAR) END AS emitted FROM ta JOIN r ON r.bad = (CAST(session_id AS BIGINT) % 3 = 0)""")
def retry_windows(spark, sf_dir):
    """Failed sessions alone are run again, on the policy's backoff and as often as it says; what was emitted before a failure stays."""
    out = Engine(spark).run(Flow("flaky", _chain_types(), [Flaky]), _seed(spark, sf_dir), now=T0)
    made = out.facts.filter("type = 'pulse'").groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ins_seq", "value"))), lambda x: x["value"]), ",").alias("emitted"))
    return out.runs.join(made, "session_id").select("session_id", "outcome", "at", "emitted")


class Late(Operator):
    """Waits twenty seconds after its session becomes ready."""

    operator_id = "op_late"
    policy = OperatorPolicy(rerun_on_new_data=False, debounce=timedelta(seconds=20))
    depends_on, produces = ("error",), ("pulse",)

    def transform(self, ctx: Context) -> DataFrame:
        return ctx.sessions.select("session_id", F.lit("pulse").alias("type"), F.lit("1").alias("value"))


@query(CHAIN_SQL + " SELECT session_id, 'op_tally' AS operator_id, TIMESTAMP '2026-01-01' AS at FROM ta UNION ALL SELECT DISTINCT session_id, 'op_late', TIMESTAMP '2026-01-01 00:00:20' FROM d WHERE type = 'error'")
def debounced_operators(spark, sf_dir):
    """When each operator ran: at once, or when its window was due."""
    return Engine(spark).run(Flow("late", _chain_types(), [Tally, Late]), _seed(spark, sf_dir), now=T0).runs.select("session_id", "operator_id", "at")


@query(CHAIN_SQL + " SELECT s.session_id, 'COMPLETED' AS status, ta.session_id IS NOT NULL AS tallied, e.session_id IS NOT NULL AS stalled FROM (SELECT DISTINCT session_id FROM d) s LEFT JOIN ta USING (session_id) LEFT JOIN (SELECT DISTINCT session_id FROM d WHERE type = 'error') e USING (session_id)")
def deadline_sessions(spark, sf_dir):
    """The deadline comes before the window: what is there is kept, sessions end, and operators that could still have run are named."""
    out = Engine(spark).run(Flow("late", _chain_types(), [Tally, Late], completes_when="pulse", deadline=timedelta(seconds=15)), _seed(spark, sf_dir), now=T0)
    tallied = out.facts.filter("type = 'tally'").select("session_id", F.lit(True).alias("tallied"))
    stalled = out.stalled.filter("operator_id = 'op_late'").select("session_id", F.lit(True).alias("stalled"))
    return out.sessions.select("session_id", "status").join(tallied, "session_id", "left").join(stalled, "session_id", "left").fillna(False, ["tallied", "stalled"])


@query(CHAIN_SQL + " SELECT s.session_id, CASE WHEN ri.session_id IS NOT NULL THEN 'COMPLETED' ELSE 'PARKED' END AS status, CASE WHEN ri.session_id IS NOT NULL THEN 'final' ELSE 'in_progress' END AS document, TIMESTAMP '2026-01-01' + to_seconds(CASE WHEN ri.session_id IS NOT NULL THEN 0 ELSE 30 END) AS written_at "
       "FROM (SELECT DISTINCT session_id FROM d) s LEFT JOIN ri USING (session_id)")  # fmt: skip
def interim_documents(spark, sf_dir):
    """Sessions that wait for a risk park with an interim document, written when its window is due; complete ones have a final document at once."""
    flow = Flow("interim", _chain_types(), [Tally, Risk], [Interim], completes_when="risk", park_after=timedelta(hours=1))
    out = Engine(spark, _base(spark, "engine")).run(flow, _seed(spark, sf_dir), now=T0)
    return out.sessions.join(out.documents.select(F.col("key").alias("session_id"), F.col("status").alias("document"), F.col("updated_at").alias("written_at")), "session_id").select("session_id", "status", "document", "written_at")


class Interim(Aggregator):
    operator_id = "agg_interim"
    policy = OperatorPolicy(rerun_on_new_data=False, debounce=timedelta(seconds=30))
    interim_refresh = True

    def aggregate(self, ctx: Context) -> DataFrame:
        return ctx.sessions.select("session_id", F.lit("interim").alias("table"), F.col("session_id").alias("key"), F.lit("{}").alias("document"))


class Wire(Capability):
    capability_id = "cap_wire"
    kinds = ("wire",)

    def activate(self, credentials):
        if credentials.get("refused"):
            raise ConnectionRefusedError("no")


class UseWire(Operator):
    operator_id = "op_wire"
    policy = OperatorPolicy(rerun_on_new_data=False)
    requires, produces = ("wire",), ("pulse",)

    def transform(self, ctx: Context) -> DataFrame:
        return ctx.sessions.select("session_id", F.lit("pulse").alias("type"), F.lit("1").alias("value"))


@query(f"WITH {GRADED}, s AS (SELECT DISTINCT session_id, namespace_id FROM g), o(bad, outcome, t) AS (VALUES (false, 'activated', 0), (true, 'failed', 0), (true, 'given_up', 10)) "
       "SELECT session_id, outcome, TIMESTAMP '2026-01-01' + to_seconds(t) AS at, NOT bad AS used FROM s JOIN o ON o.bad = (namespace_id = '3')")  # fmt: skip
def capability_activation(spark, sf_dir):
    """Connections by namespace: a refused one is tried again after its cool-off and then given up; operators run where it is live, and all of it is audited."""
    catalog = control.Catalog(credentials={("3", "cap_wire"): {"refused": True}})
    flow = Flow("wire", _chain_types(), [UseWire], capabilities=[Wire])
    trail = audit.AuditTrail(spark, _base(spark, "audit"))
    on = Activator(flow.capabilities, catalog.credentials_for, max_attempts=2, cool_off=timedelta(seconds=10))
    out = Engine(spark, audit=trail, activator=on).run(flow, _seed(spark, sf_dir), now=T0)
    used = out.facts.filter("type = 'pulse'").select("session_id", F.lit(True).alias("used"))
    return trail.table.read().filter("kind = 'capability'").select("session_id", "outcome", "at").join(used, "session_id", "left").fillna(False, ["used"])


@query(CHAIN_SQL + """, a AS (SELECT session_id, type AS subject, 'data_point' AS kind, 'ADDED' AS outcome, count(*) AS n FROM (SELECT session_id, type, value_key FROM d WHERE type NOT IN ('view', 'noise', 'error') UNION ALL SELECT * FROM ch) GROUP BY ALL
UNION ALL SELECT session_id, type, 'data_point', 'ADDED', count(*) FROM d WHERE type = 'error' GROUP BY ALL
UNION ALL SELECT g.session_id, 'error', 'data_point', 'UPDATED', count(*) - (SELECT count(*) FROM d WHERE d.session_id = g.session_id AND d.type = 'error') FROM g WHERE type = 'error' GROUP BY 1 HAVING count(*) > (SELECT count(*) FROM d WHERE d.session_id = g.session_id AND d.type = 'error')
UNION ALL SELECT session_id, 'op_tally', 'operator_run', 'succeeded', 1 FROM ta UNION ALL SELECT session_id, 'op_risk', 'operator_run', 'succeeded', 1 FROM ri UNION ALL SELECT session_id, 'op_alert', 'operator_run', 'succeeded', 1 FROM ri)
SELECT session_id, kind, subject, outcome, n, true AS contiguous FROM a""")
def audit_trail(spark, sf_dir):
    """The audit of a run, as the trail holds it: additions, runs and every emission of a type that wants it; sequences of a session have no gaps."""
    trail = audit.AuditTrail(spark, _base(spark, "audit"))
    Engine(spark, audit=trail).run(Flow("chain", _chain_types(), [Tally, Risk, Alert]), _seed(spark, sf_dir), now=T0)
    rows = trail.table.read()
    whole = rows.groupBy("session_id").agg((F.max("sequence") == F.count(F.lit(1))).alias("contiguous"))
    single = rows.filter("kind in ('data_point', 'operator_run')").groupBy("session_id", "kind", "subject", "outcome").agg(F.sum("n").alias("n"))
    return single.join(whole, "session_id")


@query(CHAIN_SQL + " SELECT 'facts' AS name, count(*)::BIGINT AS value FROM (SELECT session_id, type, value_key FROM d UNION ALL SELECT * FROM ch) UNION ALL SELECT 'facts_updated', 0 UNION ALL SELECT 'merges', 4 "
       "UNION ALL SELECT 'runs.op_tally.succeeded', count(*) FROM ta UNION ALL SELECT 'runs.op_risk.succeeded', count(*) FROM ri UNION ALL SELECT 'runs.op_alert.succeeded', count(*) FROM ri")  # fmt: skip
def run_metrics(spark, sf_dir):
    """The counters of a run: facts counted while they are written, merges, and runs by operator and outcome."""
    return Engine(spark).run(Flow("chain", _chain_types(), [Tally, Risk, Alert]), _seed(spark, sf_dir), now=T0).telemetry.table(spark)


class Spread(Operator):
    """Several facts for each session, in an order of its own, and one of a type that it does not declare."""

    operator_id = "op_spread"
    policy = OperatorPolicy(rerun_on_new_data=False)
    depends_on, produces = ("purchase",), ("pulse",)

    def transform(self, ctx: Context) -> DataFrame:
        return ctx.sessions.select("session_id", F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in (("pulse", "3"), ("pulse", "1"), ("alert", "9"), ("pulse", "2"))])).alias("e")).select("session_id", "e.*")


@query(CHAIN_SQL + ", o(position, type, value) AS (VALUES (1, 'tally', NULL), (2, 'pulse', '3'), (3, 'pulse', '1'), (4, 'alert', '9'), (5, 'pulse', '2')) SELECT session_id, position, o.type, coalesce(value, CAST(v AS VARCHAR)) AS value FROM ta, o")
def emission_order(spark, sf_dir):
    """Facts that operators made, in order of arrival: by operator as declared, then in each operator's own order; undeclared ones are merged too."""
    out = Engine(spark).run(Flow("spread", _chain_types(), [Tally, Spread]), _seed(spark, sf_dir), now=T0)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ins_seq"))
    return out.facts.filter("type in ('tally', 'pulse', 'alert')").select("session_id", place.alias("position"), "type", "value")


@query(f"WITH {FACTS}, e AS (SELECT session_id AS key, max(value_key) AS document FROM f WHERE batch < 3 GROUP BY 1), l AS (SELECT session_id AS key, max(value_key) AS document FROM f WHERE batch >= 3 AND type = 'error' GROUP BY 1) "
       "SELECT coalesce(e.key, l.key) AS key, coalesce(l.document, e.document) AS document, ((e.key IS NOT NULL)::BIGINT + (l.key IS NOT NULL)::BIGINT) AS version, CASE WHEN l.key IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS epoch FROM e FULL JOIN l ON e.key = l.key")  # fmt: skip
def durable_upserts(spark, sf_dir):
    """The store after two batches of documents, the second under a higher epoch and with the versions that it expects; a batch with another version is refused."""
    facts = event_facts(spark, sf_dir)
    batch = lambda rows: materialize(rows.groupBy(F.col("session_id").alias("key")).agg(F.max("value_key").alias("document")).select(F.lit("t").alias("table_name"), "key", "document", F.lit(durable.FINAL).alias("status"), F.lit(T0).cast("timestamp_ntz").alias("updated_at")), "batch")
    store, early, late = durable.DurableStore(spark, _base(spark, "durable")), batch(facts.filter("batch < 3")), batch(facts.filter("batch >= 3 and type = 'error'"))
    store.upsert(early, 1)
    seen = late.select("table_name", "key").join(store.read("t").select("key", "version"), "key", "left").select("table_name", "key", F.coalesce("version", F.lit(0)).cast("bigint").alias("version"))
    store.upsert(late, 2, seen)
    try:
        store.upsert(late, 2, seen)
    except VersionConflictError:
        return store.read("t").select("key", "document", "version", "epoch")
    raise AssertionError("a stale version was accepted")


@query(f"WITH {FACTS} SELECT namespace_id AS key, type AS field, count(DISTINCT session_id) AS cardinality FROM f WHERE EXISTS (SELECT 1 FROM f x WHERE x.batch >= 5 AND x.namespace_id = f.namespace_id AND x.type = f.type) GROUP BY ALL")
def durable_sets(spark, sf_dir):
    """What adding a second batch to the stored sets returns: the size of every touched set."""
    store = durable.DurableStore(spark, _base(spark, "sets"))
    members = event_facts(spark, sf_dir).select(F.lit("t").alias("table_name"), F.col("namespace_id").alias("key"), F.col("type").alias("field"), F.col("session_id").alias("member"), "batch")
    store.add_to_set(members.filter("batch < 5"), 1)
    return store.add_to_set(members.filter("batch >= 5"), 2).select("key", "field", "cardinality")


@query(f"WITH {GRADED} SELECT type, count(DISTINCT session_id || '|' || value_key) AS n, true AS complete, 3::BIGINT AS epoch FROM g GROUP BY 1")
def managed_reopen(spark, sf_dir):
    """A group that was run to its end, to which the rest of the events is delivered: it reopens under a higher epoch and holds every fact once."""
    facts = _graded(spark, sf_dir)
    boss = Manager(spark, _base(spark, "manager"), Flow("kept", _chain_types()))
    boss.start("g", facts.filter("batch < 7").drop("batch", "event_id", "value_key"), now=T0)
    stamp = F.date_format("first_retrieved", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    payload = F.to_json(F.struct("type", F.col("value").cast("bigint").alias("value"), "retrieved_by", stamp.alias("first_retrieved"), stamp.alias("last_retrieved")))
    boss.deliver("g", facts.filter("batch >= 7").select("session_id", payload.alias("payload"), F.col("ins_seq").alias("seq")), reopen_if_complete=True, now=T0)
    kept, *_ = boss._stores("g")
    return kept.read().groupBy("type").agg(F.count(F.lit(1)).alias("n")).select("type", "n", F.lit(boss.locks.is_complete("g")).alias("complete"), F.lit(boss.locks.epoch("g")).cast("bigint").alias("epoch"))


@query("SELECT n_name AS session_id, 1::BIGINT AS acted, CASE WHEN n_regionkey = 0 THEN 'reverted' ELSE 'committed' END AS state, 2::BIGINT AS epoch, n_regionkey = 1 AS complete FROM nation")
def effects_and_leases(spark, sf_dir):
    """For each nation: an effect that is asked for twice happens once (in one region it fails and is taken back), and a lease that is given back is taken under the next epoch."""
    base = _base(spark, "control")
    fx, locks, out = control.Effects(spark, base), control.Locks(spark, base), []
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_regionkey").collect():  # 25 rows
        name, acted = r["n_name"], 0
        for _ in range(1 if r["n_regionkey"] == 0 else 2):
            with contextlib.suppress(InterruptedError), fx.once(name, "op", "mail", 1) as go:
                acted += bool(go)
                if r["n_regionkey"] == 0:
                    raise InterruptedError
        locks.release(name, locks.acquire(name))
        epoch = locks.acquire(name)
        if r["n_regionkey"] == 1:
            locks.mark_complete(name, epoch)
        out.append((name, acted, fx.state(name, "op", "mail"), locks.epoch(name), locks.is_complete(name)))
    return local(spark, out, "session_id string, acted bigint, state string, epoch bigint, complete boolean")


def _shape_types() -> TypeRegistry:
    types = TypeRegistry()
    types.define("pair", config=TypeConfig(pii=True), value="map<string,bigint>")
    types.define("bag", config=TypeConfig(pii=True), value="array<bigint>", is_set=True)
    return types


def _shaped(spark, sf_dir):
    """Events as maps and sets of numbers, written with their parts in other orders and more than once."""
    e = event_facts(spark, sf_dir)
    v = F.col("value")
    value = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"b":'), v, F.lit(',"a":'), F.col("event_id") % 3, F.lit("}"))).otherwise(F.concat(F.lit("[7,"), v, F.lit(", "), v, F.lit(",7]")))
    return e.withColumn("type", F.when(F.col("event_id") % 2 == 0, "pair").otherwise("bag")).withColumn("value", value)


@query(f"""WITH {FACTS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{{"v":{{"m":[{{"k":"a","v":' || CAST(event_id % 3 AS VARCHAR) || '}},{{"k":"b","v":' || value_key || '}}]}}}}'
WHEN value_key = '7' THEN '{{"v":{{"s":[7]}}}}' ELSE '{{"v":{{"s":[' || least(CAST(value_key AS BIGINT), 7) || ',' || greatest(CAST(value_key AS BIGINT), 7) || ']}}}}' END AS value_key FROM f""")
def canonical_values(spark, sf_dir):
    """The key of nested values: maps by name, sets sorted and without repeats, whatever order they were written in."""
    return _shaped(spark, sf_dir).select("event_id", _shape_types().value_keys().alias("value_key"))


@query(f"WITH {FACTS} SELECT session_id, count(DISTINCT value_key || '|' || (CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 AS VARCHAR) ELSE 'bag' END)) AS n_values, count(DISTINCT value_key || '|' || (CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 AS VARCHAR) ELSE 'bag' END)) AS n_hashes, 0::BIGINT AS n_shared, count(*) AS n_opened FROM f GROUP BY 1")
def sealed_values(spark, sf_dir):
    """Personal values under keys by namespace: as many hashes as values, none of them another session's, and every value is read back as it was."""
    types = _shape_types()
    facts = _shaped(spark, sf_dir).withColumn("value_key", types.value_keys()).withColumn("plain", F.col("value"))
    sealed = materialize(sealing.seal_facts(facts.withColumn("key", F.col("value_key")), types, sealing.CipherProvider(KEYS)), "sealed")
    owners = sealed.select("value_hash", "session_id").distinct().groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"))
    back = sealing.unseal_facts(sealed, sealing.CipherProvider(KEYS)).join(owners, "value_hash")
    return back.groupBy("session_id").agg(F.count_distinct("key").alias("n_values"), F.count_distinct("value_hash").alias("n_hashes"), F.count_if(F.col("owners") > 1).alias("n_shared"), F.count_if(F.col("value") == F.col("plain")).alias("n_opened"))


@query(f"WITH {FACTS} SELECT event_id, sha256(session_id || chr(0) || CAST(seq AS VARCHAR)) AS entry_id, '<redacted>' AS a, NULL::VARCHAR AS b FROM f")
def entry_ids_and_parameters(spark, sf_dir):
    """Ids that a retried append makes again, and parameters without their values."""
    rows = inbox.entry_ids(event_facts(spark, sf_dir).withColumn("seq", F.col("ins_seq")))
    told = sealing.redact_parameters(F.create_map(F.lit("a"), F.col("value")))
    return rows.select("event_id", "entry_id", told["a"].alias("a"), F.try_element_at(told, F.lit("b")).alias("b"))


@query(f"WITH {GRADED} SELECT session_id, count(DISTINCT type) >= 5 OR bool_or(type = 'signup' AND value_key > '3') AS satisfied FROM g GROUP BY 1")
def completion_custom(spark, sf_dir):
    """A condition of the user's own, any of two, over all facts."""
    many = lambda facts: facts.groupBy("session_id").agg((F.count_distinct("type") >= 5).alias("satisfied"))
    high = lambda facts: facts.groupBy("session_id").agg(F.bool_or((F.col("type") == "signup") & (F.col("value_key") > "3")).alias("satisfied"))
    facts = _graded(spark, sf_dir)
    return completion.satisfied(facts, facts.select("session_id"), completion.any_of(completion.Custom(many, "many"), completion.Custom(high, "high")), TYPES)


DECLARED_SQL = "n(node, cap) AS (VALUES " + ", ".join(f"('{x}', {c})" for x, c in [("op_tally", False), ("op_risk", False), ("op_alert", False), ("op_pulse", False), ("op_watch", False), ("agg_report", False), ("cap_desk", True)]) + """),
p(node, leaf) AS (VALUES ('op_tally', 'tally'), ('op_risk', 'risk'), ('op_alert', 'alert'), ('op_pulse', 'pulse'), ('op_pulse', 'purchase'), ('op_watch', 'pulse')),
d(node, wanted) AS (VALUES ('op_tally', 'purchase'), ('op_risk', 'tally'), ('op_risk', 'error'), ('op_alert', 'risk'), ('op_pulse', 'purchase'), ('op_watch', 'engagement'), ('agg_report', 'risk'), ('cap_desk', 'tally')), u(node, wanted) AS (VALUES ('op_pulse', 'pulse'))"""
CHAIN_LINEAGE_SQL = "lin(leaf, wanted) AS (VALUES " + ", ".join(f"('{x}', '{a}')" for x in _chain_types().names() if not _chain_types()[x].abstract for a in sorted(_chain_types().ancestors(x))) + ")"


@query(f"WITH RECURSIVE {DECLARED_SQL}, {CHAIN_LINEAGE_SQL}, e AS (SELECT DISTINCT p.node AS src, d.node AS dst FROM p JOIN lin ON p.leaf = lin.leaf JOIN d ON d.wanted = lin.wanted), w AS (SELECT DISTINCT p.node AS src, u.node AS dst FROM p JOIN lin ON p.leaf = lin.leaf JOIN u ON u.wanted = lin.wanted WHERE p.node <> u.node), "
       "r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT 'edge' AS what, src, dst FROM e UNION ALL SELECT 'weak', src, dst FROM w UNION ALL SELECT 'cycle', src, dst FROM r WHERE src = dst "
       "UNION ALL SELECT 'dropped', node, node FROM n WHERE cap")  # fmt: skip
def graph_analysis(spark, sf_dir):
    """Strong and weak edges, nodes on cycles, and the capability that a catalog without grants takes out; the SQL joins the declarations."""
    types = _chain_types()
    nodes = [Tally(), Risk(), Alert(), Pulse(), Watch(), Report(), Desk()]
    strong, weak = graph.build_edges(nodes, types), graph.build_uses_edges(nodes, types)
    left = {graph.node_id(x) for x in graph.restrict_to_permitted(nodes, ())}
    rows = [("edge", a, b) for a in strong for b in strong[a]] + [("weak", a, b) for a in weak for b in weak[a]]
    rows += [("cycle", x, x) for cycle in graph.find_cycles(strong) for x in cycle] + [("dropped", x, x) for x in strong if x not in left]
    return local(spark, rows, "what string, src string, dst string")


@query(f"WITH RECURSIVE {DECLARED_SQL}, {CHAIN_LINEAGE_SQL}, k(node) AS (SELECT p.node FROM p JOIN lin ON p.leaf = lin.leaf WHERE lin.wanted IN ('alert', 'risk', 'pulse') AND p.node <> 'op_pulse' UNION "
       "SELECT p.node FROM k JOIN d ON d.node = k.node JOIN lin ON lin.wanted = d.wanted JOIN p ON p.leaf = lin.leaf WHERE p.node <> 'op_pulse') SELECT node, true AS bounded FROM k")  # fmt: skip
def pruned_operators(spark, sf_dir):
    """What a flow keeps for an aggregator that consumes alerts and a condition that waits for a pulse."""
    flow = Flow("pruned", _chain_types(), [Tally, Risk, Alert, Watch, Stray], [Report], completes_when="pulse")
    return local(spark, [(x.operator_id, x.operator_id in flow.edges) for x in flow.pruned], "node string, bounded boolean")


class Stray(Operator):
    """Makes what nobody consumes."""

    operator_id = "op_stray"
    policy = OperatorPolicy(rerun_on_new_data=False)
    depends_on, produces = ("alert",), ("signup",)

    def transform(self, ctx: Context) -> DataFrame:
        return ctx.latest("alert").select("session_id", F.lit("signup").alias("type"), F.lit("0").alias("value"))


@query(f"WITH {MERGED} SELECT session_id, type, value_key, retrieved_by, last_retrieved FROM m")
def streaming_merge(spark, sf_dir):
    """The events as a stream of files, merged micro-batch by micro-batch: the batch answer."""
    base = _base(spark, "stream")
    facts = _in_turn(event_facts(spark, sf_dir)).drop("event_id", "value_key")
    facts.repartition(3).write.parquet(f"{base}/in")
    store = StreamingStore(spark, base, TYPES)
    schema = facts.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(f"{base}/in").drop("batch")
    q = store.start(stream, f"{base}/checkpoint")
    q.awaitTermination(600)
    if q.exception() is not None:
        raise q.exception()
    return store.facts.read().select("session_id", "type", F.col("value").alias("value_key"), "retrieved_by", "last_retrieved")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
l AS (SELECT l_orderkey, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18, 2))), 2) AS DECIMAL(28, 2)) AS gross, count(*) AS n FROM lineitem GROUP BY 1)
SELECT n_name, count(*) AS n_orders, sum(l.n)::BIGINT AS n_lines, CAST(sum(l.gross) AS DECIMAL(38, 2)) AS gross, sum(CASE WHEN l.n >= 5 THEN 1 ELSE 0 END)::BIGINT AS n_risky
FROM o JOIN l ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def order_risk_report(spark, sf_dir):
    """A flow over orders: each is a session that starts with its total; one operator adds its lines, the aggregator reports it, and reports are summed by nation."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    types = TypeRegistry()
    types.define("placed", config=TypeConfig(), value="bigint")
    types.define("lines", config=TypeConfig(), value="struct<gross:decimal(28,2),n:bigint>")
    sums = t("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("session_id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("gross"), F.count(F.lit(1)).alias("n"))

    class AddLines(Operator):
        policy = OperatorPolicy(rerun_on_new_data=False, timeout=timedelta(minutes=30))
        depends_on, produces = ("placed",), ("lines",)

        def transform(self, ctx: Context) -> DataFrame:
            return ctx.sessions.join(sums, "session_id").select("session_id", F.lit("lines").alias("type"), F.to_json(F.struct("gross", "n")).alias("value"))

    class ReportOrder(Aggregator):
        policy = OperatorPolicy(rerun_on_new_data=False, timeout=timedelta(minutes=30))
        depends_on, consumes = ("lines",), ("lines",)

        def aggregate(self, ctx: Context) -> DataFrame:
            buyer = ctx.of_type("placed").select("session_id", F.col("value").alias("customer"))
            return ctx.latest("lines").join(buyer, "session_id").select("session_id", F.lit("orders").alias("table"), "customer", F.col("session_id").alias("key"), F.col("value").alias("document")).select("session_id", "table", "key", F.concat(F.lit('{"customer":'), "customer", F.lit(","), F.substring("document", 2, 1 << 20)).alias("document"))

    orders = t("orders").select(F.col("o_orderkey").cast("string").alias("session_id"), F.lit("0").alias("namespace_id"), F.lit("placed").alias("type"), F.col("o_custkey").cast("string").alias("value"), F.lit("orders").alias("retrieved_by"), F.lit(T0).cast("timestamp_ntz").alias("first_retrieved"), F.lit(T0).cast("timestamp_ntz").alias("last_retrieved"), F.col("o_orderkey").cast("bigint").alias("ins_seq"))
    docs = Engine(spark, _base(spark, "orders")).run(Flow("orders", types, [AddLines], [ReportOrder], deadline=timedelta(hours=1)), orders, now=T0).documents
    told = docs.select(F.from_json("document", "customer bigint, gross decimal(28,2), n bigint").alias("d")).select("d.*")
    joined = told.join(t("customer").select("c_custkey", "c_nationkey"), F.col("customer") == F.col("c_custkey")).join(F.broadcast(t("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("n").alias("n_lines"), F.sum("gross").cast("decimal(38,2)").alias("gross"), F.count_if(F.col("n") >= 5).alias("n_risky"))


@query("SELECT d.lang, count(*) AS n_docs, count(DISTINCT sha256(coalesce(text, ''))) AS n_texts, sum(length(coalesce(text, '')))::BIGINT AS n_chars, sum(coalesce(l.toxic, 0))::BIGINT AS n_toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def document_quality_report(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", "lang", F.sha2(text, 256).alias("h"), F.length(text).alias("n"))
    return sized.join(labels, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("h").alias("n_texts"), F.sum("n").cast("bigint").alias("n_chars"), F.sum(F.coalesce("toxic", F.lit(0))).cast("bigint").alias("n_toxic"))


@query(f"WITH {FACTS} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch END AS pending_epoch FROM (SELECT event_id, batch AS epoch FROM f)")
def effect_pending_epochs(spark, sf_dir):
    """The claiming epoch of each effect state; a third of the states are malformed."""
    e = event_facts(spark, sf_dir)
    state = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("pending:x"), F.col("batch"))).otherwise(F.concat(F.lit("pending:"), F.col("batch")))
    return e.select("event_id", sealing.pending_epoch(state).alias("pending_epoch"))
