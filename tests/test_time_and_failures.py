"""What the engine does about time, failures and capabilities: windows, retries, deadlines, isolation, gating, drift, rechecks."""

import logging
import time
from datetime import timedelta

import pytest
from helpers import T0, T1, Aggregator, Capability, OperatorPolicy, RetryPolicy, facts_of, operator, registry, seed
from pyspark.sql import functions as F

from factloom.engine import Engine
from factloom.errors import StepLimitError
from factloom.flow import Flow
from factloom.lite import run_session
from factloom.manager import Manager
from factloom.operators.activation import Activator
from factloom.sources.audit import AuditTrail
from factloom.sources.control import Catalog

TYPES = registry()


def emit(kind, value):
    return lambda self, ctx: ctx.sessions.select("session_id", F.lit(kind).alias("type"), F.lit(value).alias("value"))


def log_of(result):
    return sorted((r.session_id, r.operator_id, r.outcome, (r.at - T1).total_seconds()) for r in result.runs.collect())


def test_one_bad_session_fails_alone(spark):
    def transform(self, ctx):
        broken = F.when(F.col("session_id") == "s3", F.raise_error(F.lit("broken"))).otherwise(F.lit("1.0"))
        return ctx.sessions.select("session_id", F.lit("risk").alias("type"), broken.alias("value"))

    flow = Flow("f", TYPES, [operator("x", ("ip",), ("risk",), transform=transform)])
    rows = [(f"s{i}", "ip", '"1"') for i in range(8)]
    result = Engine(spark).run(flow, seed(spark, *rows), now=T1)
    assert [r[0] for r in facts_of(result.facts.filter("type = 'risk'"), "session_id")] == [f"s{i}" for i in range(8) if i != 3]
    assert {r.session_id: r.outcome for r in result.runs.collect()} == {f"s{i}": "failed" if i == 3 else "succeeded" for i in range(8)}


def test_a_fault_of_the_operator_fails_everywhere_and_others_go_on(spark):
    def transform(self, ctx):
        raise RuntimeError("no")

    flow = Flow("f", TYPES, [operator("bad", ("ip",), ("risk",), transform=transform), operator("good", ("ip",), ("risk",), [("risk", "2.0")])])
    result = Engine(spark).run(flow, seed(spark, ("s", "ip", '"1"'), ("t", "ip", '"1"')), now=T1)
    assert {(r.operator_id, r.outcome) for r in result.runs.collect()} == {("bad", "failed"), ("good", "succeeded")} and result.facts.filter("type = 'risk'").count() == 2


def test_types_that_cannot_be_emitted_fail_their_session_only(spark):
    def transform(self, ctx):
        kind = F.when(F.col("session_id") == "s", F.lit("email")).otherwise(F.lit("risk"))
        return ctx.sessions.select("session_id", kind.alias("type"), F.lit("1.0").alias("value"))

    result = Engine(spark).run(Flow("f", TYPES, [operator("x", ("ip",), ("risk",), transform=transform)]), seed(spark, ("s", "ip", '"1"'), ("t", "ip", '"1"')), now=T1)
    assert {r.session_id: (r.outcome, r.detail) for r in result.runs.collect()} == {"s": ("failed", "InvalidTypeError: email cannot be emitted"), "t": ("succeeded", None)}
    assert facts_of(result.facts.filter("type <> 'ip'"), "session_id", "type") == [("t", "risk")]


def test_retries_wait_for_their_backoff(spark):
    def transform(self, ctx):
        raise RuntimeError("no")

    retry = RetryPolicy(max_attempts=3, base=timedelta(seconds=10), jitter=0.0)
    flow = Flow("f", TYPES, [operator("x", ("ip",), ("risk",), retry=retry, transform=transform)])
    assert log_of(Engine(spark).run(flow, seed(spark, ("s", "ip", '"1"')), now=T1)) == [("s", "x", "failed", 30.0), ("s", "x", "retrying", 0.0), ("s", "x", "retrying", 10.0)]
    capped = Flow("f", TYPES, [operator("x", ("ip",), ("risk",), retry=retry, max_cycles=2, transform=transform)])
    assert [x[2] for x in log_of(Engine(spark).run(capped, seed(spark, ("s", "ip", '"1"')), now=T1))] == ["failed", "retrying"]  # the breaker ends retries


def test_debounce_arms_once_and_the_deadline_beats_it(spark, caplog):
    slow = operator("slow", ("ip",), ("risk",), [("risk", "1.0")], debounce=timedelta(seconds=20))
    quick = operator("quick", ("ip",), ("geo",), [("geo", '{"x":1.0}')])
    result = Engine(spark).run(Flow("f", TYPES, [slow, quick]), seed(spark, ("s", "ip", '"1"')), now=T1)
    assert log_of(result) == [("s", "quick", "succeeded", 0.0), ("s", "slow", "succeeded", 20.0)] and not result.deadline_hit
    with caplog.at_level(logging.WARNING):
        cut = Engine(spark).run(Flow("f", TYPES, [slow, quick], completes_when="risk", deadline=timedelta(seconds=15)), seed(spark, ("s", "ip", '"1"')), now=T1)
    assert cut.deadline_hit and [x[1] for x in log_of(cut)] == ["quick"] and cut.sessions.first().status == "COMPLETED"
    assert facts_of(cut.stalled, "session_id", "operator_id") == [("s", "slow")] and any("could be reached" in r.message for r in caplog.records)
    # The armed window is kept: a later run goes on from it.
    later = Engine(spark).run(Flow("f", TYPES, [slow, quick]), cut.facts.limit(0).drop("value_key", "added_rev", "updated_rev"), cut.facts, cut.op_state, now=T1 + timedelta(seconds=16))
    assert [(x[1], x[3]) for x in log_of(later)] == [("slow", 20.0)]


def test_a_run_without_an_end_raises(spark):
    grow = lambda self, ctx: ctx.store.groupBy("session_id").agg(F.count(F.lit(1)).cast("double").cast("string").alias("value")).withColumn("type", F.lit("risk"))
    flow = Flow("f", TYPES, [operator("x", ("risk",), ("risk",), reruns=True, max_cycles=50, transform=grow)])
    with pytest.raises(StepLimitError):
        Engine(spark).run(flow, seed(spark, ("s", "risk", "0.0")), now=T1, max_steps=2)


def test_emissions_keep_their_order(spark):
    def transform(self, ctx):
        return ctx.sessions.select("session_id", F.explode(F.array(*[F.lit(f'"{x}"') for x in "dbca"])).alias("value")).select("session_id", F.lit("ip").alias("type"), "value")

    result = Engine(spark).run(Flow("f", TYPES, [operator("x", ("risk",), ("ip",), transform=transform), operator("y", ("risk",), ("ip",), [("ip", '"z"')])]), seed(spark, ("s", "risk", "1.0"), ("t", "risk", "1.0")), now=T1)
    assert [r.value for r in result.facts.filter("session_id = 's' and type = 'ip'").orderBy("ins_seq").collect()] == [f'"{x}"' for x in "dbcaz"]


def caps():
    net = type("net", (Capability,), {"capability_id": "net", "kinds": ("web",), "depends_on": ("ip",)})
    spare = type("spare", (Capability,), {"capability_id": "spare", "kinds": ("web",)})
    return [net, spare]


def test_operators_see_what_their_sessions_may_use(spark):
    def transform(self, ctx):
        chosen = ctx.capabilities.require("web")
        return chosen.select("session_id", F.lit("answer").alias("type"), F.concat(F.lit('"'), "capability_id", F.lit('"')).alias("value"))

    user = operator("user", ("risk",), ("answer",), requires=("web",), transform=transform)
    flow = Flow("f", TYPES, [user], capabilities=caps())
    rows = seed(spark, ("a", "risk", "1.0"), ("a", "ip", '"1"'), ("b", "risk", "1.0"), ("c", "risk", "1.0"), ("c", "ip", '"1"'), ("d", "risk", "1.0"))
    catalog = Catalog(capabilities={"ns_a": None, "ns_b": None, "ns_c": {"net"}, "ns_d": {"net"}}, preferred={"ns_a": ("spare",)})
    result = Engine(spark, catalog=catalog).run(flow, rows, now=T1)
    assert facts_of(result.facts.filter("type = 'answer'"), "session_id", "value") == [("a", '"spare"'), ("b", '"spare"'), ("c", '"net"')]


def test_a_new_capability_is_a_reason_to_rerun(spark):
    seeder = operator("seeder", ("risk",), ("ip",), [("ip", '"1"')])
    user = operator("user", ("risk",), ("tags",), [("tags", "[]")], reruns=True)
    once = operator("once", ("risk",), ("tags",), [("tags", "[]")])
    result = Engine(spark).run(Flow("f", TYPES, [seeder, user, once], capabilities=caps()), seed(spark, ("s", "risk", "1.0")), now=T1)
    assert {r.operator_id: r.runs for r in result.op_state.collect()} == {"seeder": 1, "user": 2, "once": 1}


def test_capabilities_are_activated_and_their_failures_audited(spark, tmp_path):
    class Web(Capability):
        capability_id = "web1"
        kinds = ("web",)

        def activate(self, credentials):
            if credentials["bad"]:
                raise OSError("down")

    base = f"file://{tmp_path}"
    user = operator("user", ("risk",), ("tags",), [("tags", "[]")], requires=("web",))
    flow = Flow("f", TYPES, [user], capabilities=[Web])
    on = Activator(flow.capabilities, lambda ns, cap: {"bad": ns == "ns_t"}, max_attempts=2, cool_off=timedelta(seconds=10))
    trail = AuditTrail(spark, base)
    result = Engine(spark, base, audit=trail, activator=on).run(flow, seed(spark, ("s", "risk", "1.0"), ("t", "risk", "1.0")), now=T1)
    assert facts_of(result.facts.filter("type = 'tags'"), "session_id") == [("s",)]
    told = sorted((r.session_id, r.outcome, (r.at - T1).total_seconds()) for r in trail.table.read().filter("kind = 'capability'").collect())
    assert told == [("s", "activated", 0.0), ("t", "failed", 0.0), ("t", "given_up", 10.0)]


def test_audit_of_parks_and_skipped_aggregators(spark, tmp_path):
    base = f"file://{tmp_path}"
    never = type("never", (Aggregator,), {"operator_id": "never", "policy": OperatorPolicy(rerun_on_new_data=False), "depends_on": ("geo",)})
    trail = AuditTrail(spark, base)
    flow = Flow("f", TYPES, [], [never], completes_when="risk", park_after=timedelta(hours=1))
    result = Engine(spark, base, audit=trail).run(flow, seed(spark, ("s", "ip", '"1"'), ("t", "risk", "1.0")), now=T1)
    assert {r.session_id: r.status for r in result.sessions.collect()} == {"s": "PARKED", "t": "COMPLETED"}
    assert sorted((r.session_id, r.kind, r.subject, r.outcome) for r in trail.table.read().filter("kind <> 'data_point'").collect()) == [("s", "session_parked", None, None), ("t", "aggregation", "never", "skipped")]


def test_interim_documents_wait_for_their_window(spark, tmp_path):
    docs = lambda self, ctx: ctx.sessions.select("session_id", F.lit("r").alias("table"), F.col("session_id").alias("key"), F.lit("{}").alias("document"))
    agg = type("agg", (Aggregator,), {"operator_id": "agg", "policy": OperatorPolicy(rerun_on_new_data=False, debounce=timedelta(seconds=30)), "interim_refresh": True, "aggregate": docs})
    result = Engine(spark, f"file://{tmp_path}").run(Flow("f", TYPES, [], [agg], completes_when="risk"), seed(spark, ("s", "ip", '"1"'), ("t", "risk", "1.0")), now=T1)
    assert sorted((r.key, r.status, (r.updated_at - T1).total_seconds()) for r in result.documents.collect()) == [("s", "in_progress", 30.0), ("t", "final", 0.0)]


def test_counters(spark):
    result = Engine(spark).run(Flow("f", TYPES, [operator("x", ("ip",), ("risk",), [("risk", "1.0")])]), seed(spark, ("s", "ip", '"1"'), ("t", "ip", '"1"')), now=T1)
    assert result.telemetry.counters() == {"merges": 2, "facts": 4, "facts_updated": 0, "runs.x.succeeded": 2}
    assert [s[:2] for s in result.telemetry.spans] == [("operator", "x")] and result.telemetry.table(spark).count() == 4


def test_the_small_form_has_a_hard_deadline(spark):
    def transform(self, ctx):
        time.sleep(30)
        return ctx.sessions.select("session_id", F.lit("risk").alias("type"), F.lit("1.0").alias("value"))

    flow = Flow("f", TYPES, [operator("x", ("ip",), ("risk",), transform=transform)], deadline=timedelta(seconds=6))
    began = time.monotonic()
    out = run_session(spark, flow, seed(spark, ("s", "ip", '"1"')), now=T1)
    assert out.deadline_hit and time.monotonic() - began < 25 and out.runs.count() == 0
    assert [(r.operator_id, r.detail) for r in out.failures.collect()] == [("x", "cancelled by the deadline")]


def test_drift_is_told_and_held_groups_are_looked_at_again(spark, tmp_path, caplog):
    now = [1000.0]
    base = f"file://{tmp_path}"
    make = lambda *ops: Manager(spark, base, Flow("f", TYPES, list(ops), completes_when="geo"), Engine(spark, base, audit=AuditTrail(spark, base)), clock=lambda: now[0])
    a = operator("a", ("ip",), ("risk",), [("risk", "1.0")])
    make(a).start("g", seed(spark, ("s", "ip", '"1"')), now=T1)
    boss = make(a, operator("b", ("risk",), ("tags",), [("tags", "[]")]))
    with caplog.at_level(logging.WARNING):
        assert boss.resume("g", now=T1).facts.filter("type = 'tags'").count() == 1
    assert any("another definition" in r.message for r in caplog.records)
    assert [r.subject for r in AuditTrail(spark, base).table.read().filter("kind = 'flow_drift'").collect()] == ["f"]
    epoch = boss.locks.acquire("g")
    sent = spark.createDataFrame([("s", '{"type":"risk","value":3.0,"retrieved_by":"w","first_retrieved":"2026-01-01T00:00:00","last_retrieved":"2026-01-01T00:00:00"}', 1)], "session_id string, payload string, seq bigint")
    assert boss.deliver("g", sent, now=T0) is None and boss.poll(now=T1) == []
    boss.locks.release("g", epoch)
    now[0] += 36
    assert boss.poll(now=T1) == ["g"] and boss.poll(now=T1) == []
    assert boss._stores("g")[0].read().filter("type = 'risk'").count() == 2
