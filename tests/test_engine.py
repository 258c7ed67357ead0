"""Flows end to end: supersteps, reruns, failures, aggregators, recovery, replay, streams."""

import json
import time
from datetime import timedelta

import pytest
from helpers import T0, T1, SEED, Aggregator, Capability, OperatorPolicy, RetryPolicy, RowOperator, facts_of, operator, registry, seed
from pyspark.sql import functions as F

from factloom import introspection
from factloom.engine import Engine
from factloom.errors import GateBlockedError, SessionCompleteError
from factloom.flow import Flow
from factloom.functions.sealing import CipherProvider
from factloom.lite import run_session
from factloom.manager import Manager
from factloom.operators.base import RerunOn
from factloom.plans import completion
from factloom.sources.archive import Archive
from factloom.sources.audit import AuditTrail
from factloom.sources.control import Catalog, MemorySink
from factloom.streaming.ingest import StreamingStore, session_timers, stateful_merge

TYPES = registry()


def count_risks(self, ctx):
    n = ctx.store.groupBy("session_id").agg(F.count_if(F.col("type") == "risk").alias("risk_count"))
    return n.select("session_id", F.lit("reports").alias("table"), F.col("session_id").alias("key"), F.to_json(F.struct("risk_count")).alias("document"))


def report(**more):
    policy = OperatorPolicy(rerun_on_new_data=False, retry=more.pop("retry", RetryPolicy(max_attempts=1)))
    return type("report", (Aggregator,), {"operator_id": "report", "policy": policy, "depends_on": ("risk",), "aggregate": count_risks, **more})


def runs_of(result):
    return {(r.session_id, r.operator_id): r.n for r in result.runs.groupBy("session_id", "operator_id").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_headline(spark, tmp_path):
    scorer = operator("scorer", ("email",), ("risk",), [("risk", "0.9")])
    result = Engine(spark, f"file://{tmp_path}").run(Flow("f", TYPES, [scorer], [report()]), seed(spark, ("s1", "work_email", '"a@b"'), ("s2", "ip", '"1"')), now=T1)
    assert {r.session_id: r.status for r in result.sessions.collect()} == {"s1": "COMPLETED", "s2": "COMPLETED"}
    assert [(r.key, json.loads(r.document), r.status, r.version) for r in result.documents.collect()] == [("s1", {"risk_count": 1}, "final", 1)]
    assert runs_of(result) == {("s1", "scorer"): 1}
    made = result.facts.filter("type = 'risk'").first()
    assert (made.retrieved_by, made.first_retrieved, made.added_rev, made.namespace_id) == ("scorer", T1, 2, "ns_s1")


def test_a_capability_unblocks(spark):
    net = type("netcap", (Capability,), {"capability_id": "netcap", "kinds": ("net",), "depends_on": ("ip",)})
    seeder = operator("seeder", ("trigger",), ("ip",), [("ip", '"9"')])
    consumer = operator("consumer", (), ("risk",), [("risk", "1.0")], requires=("net",))
    flow = Flow("f", TYPES, [seeder, consumer], capabilities=[net])
    result = Engine(spark).run(flow, seed(spark, ("s", "trigger", '"go"'), ("t", "geo", '{"x":1.0}')), now=T1)
    assert facts_of(result.facts.filter("type in ('ip', 'risk')"), "session_id", "type") == [("s", "ip"), ("s", "risk")]
    held = Engine(spark, catalog=Catalog(capabilities={"ns_s": set()})).run(flow, seed(spark, ("s", "trigger", '"go"')), now=T1)
    assert held.facts.filter("type = 'risk'").count() == 0
    gated = Engine(spark, catalog=Catalog(operators={"ns_s": {"seeder"}, "ns_t": None})).run(flow, seed(spark, ("s", "trigger", '"go"'), ("t", "trigger", '"go"')), now=T1)
    assert facts_of(gated.facts.filter("type = 'risk'"), "session_id") == [("t",)]


def test_cycles_stop_at_their_bound(spark):
    def grow(kind):
        def transform(self, ctx):
            n = ctx.store.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
            return n.select("session_id", F.lit(kind).alias("type"), (F.concat(F.lit('"'), F.col("n"), F.lit('"')) if kind == "ip" else F.col("n").cast("double").cast("string")).alias("value"))

        return transform

    a = operator("a", ("risk",), ("ip",), reruns=True, max_cycles=2, transform=grow("ip"))
    b = operator("b", ("ip",), ("risk",), reruns=True, max_cycles=2, transform=grow("risk"))
    result = Engine(spark).run(Flow("f", TYPES, [a, b]), seed(spark, ("s", "risk", "0.0")), now=T1)
    assert runs_of(result) == {("s", "a"): 2, ("s", "b"): 2}


@pytest.mark.parametrize(("rerun_on", "runs"), [(RerunOn.ADDED_ONLY, 1), (RerunOn.ANY_CHANGE, 2)])
def test_reruns_by_kind_of_change(spark, rerun_on, runs):
    flow = Flow("f", TYPES, [operator("x", ("ip",), ("risk",), [("risk", "1.0")], reruns=True, rerun_on=rerun_on)])
    first = Engine(spark).run(flow, seed(spark, ("s", "ip", '"1"', T0)), now=T0)
    again = Engine(spark).run(flow, seed(spark, ("s", "ip", '"1"', T1)), first.facts, first.op_state, now=T1)
    assert again.op_state.first().runs == runs
    none = Engine(spark).run(flow, seed(spark, ("s", "ip", '"1"', T0)), first.facts, first.op_state, now=T1)
    assert none.op_state.first().runs == 1


def test_failures_are_retried_with_the_same_delta(spark):
    calls = []

    def transform(self, ctx):
        calls.append(ctx.delta.count())
        if len(calls) < 3:
            raise RuntimeError("flaky")
        return ctx.sessions.select("session_id", F.lit("risk").alias("type"), F.lit("1.0").alias("value"))

    flow = Flow("f", TYPES, [operator("x", ("ip",), ("risk",), retry=RetryPolicy(max_attempts=3), transform=transform)])
    result = Engine(spark).run(flow, seed(spark, ("s", "ip", '"1"')), now=T1)
    assert calls == [1, 1, 1] and result.facts.filter("type = 'risk'").count() == 1
    assert [r.outcome for r in result.runs.orderBy("step").collect()] == ["retrying", "retrying", "succeeded"]
    calls.clear()
    once = Engine(spark).run(Flow("f", TYPES, [operator("x", ("ip",), ("risk",), transform=transform)]), seed(spark, ("s", "ip", '"1"')), now=T1)
    assert len(calls) == 1 and once.op_state.first().failed_attempts == 0 and once.op_state.first().watermark == 1


def test_a_timeout_is_recorded(spark):
    def transform(self, ctx):
        time.sleep(5)
        return ctx.sessions.select("session_id", F.lit("risk").alias("type"), F.lit("1.0").alias("value"))

    flow = Flow("f", TYPES, [operator("x", ("ip",), ("risk",), timeout=timedelta(seconds=1), transform=transform)])
    result = Engine(spark).run(flow, seed(spark, ("s", "ip", '"1"')), now=T1)
    assert [r.outcome for r in result.runs.collect()] == ["timed_out"]


def test_rows_before_a_failure_stay(spark):
    def run(self, session, facts):
        yield "risk", "1.0"
        if session == "bad":
            raise ValueError("broken")
        yield "risk", str(float(len(facts)))

    row = operator("row", ("ip",), ("risk",), base=RowOperator, run=run, transform=RowOperator.transform)
    result = Engine(spark).run(Flow("f", TYPES, [row]), seed(spark, ("bad", "ip", '"1"'), ("good", "ip", '"1"'), ("good", "ip", '"2"')), now=T1)
    assert facts_of(result.facts.filter("type = 'risk'"), "session_id", "value") == [("bad", "1.0"), ("good", "1.0"), ("good", "2.0")]
    assert {(r.session_id, r.outcome) for r in result.runs.collect()} == {("bad", "failed"), ("good", "succeeded")}


def test_statuses(spark):
    facts = seed(spark, ("s", "ip", '"1"'), ("t", "risk", "1.0"))
    status = lambda **k: {r.session_id: r.status for r in Engine(spark).run(Flow("f", TYPES, completes_when=completion.all_of("risk"), **k.pop("flow", {})), facts, now=T1, **k).sessions.collect()}
    assert status() == {"s": "WAITING", "t": "COMPLETED"}
    assert status(flow={"park_after": timedelta(1)}) == {"s": "PARKED", "t": "COMPLETED"}
    assert status(deadline_hit=True) == {"s": "COMPLETED", "t": "COMPLETED"}


def test_aggregators_contribute_once_and_interim_ones_refresh(spark, tmp_path):
    flow = Flow("f", TYPES, [], [report(interim_refresh=True)], completes_when="ip")
    engine = Engine(spark, f"file://{tmp_path}")
    one = engine.run(flow, seed(spark, ("s", "risk", "1.0")), now=T1)
    assert [(r.status, r.version) for r in one.documents.collect()] == [("in_progress", 1)]
    two = engine.run(flow, seed(spark, ("s", "ip", '"1"')), one.facts, one.op_state, now=T1)
    assert [(r.status, r.version) for r in two.documents.collect()] == [("final", 2)]
    three = engine.run(flow, seed(spark, ("s", "risk", "2.0")), two.facts, two.op_state, now=T1)
    assert [(r.status, r.version) for r in three.documents.collect()] == [("final", 2)]


def test_a_failing_aggregator_is_a_dead_letter(spark, tmp_path):
    tries = []

    def aggregate(self, ctx):
        tries.append(1)
        raise RuntimeError("no")

    result = Engine(spark, f"file://{tmp_path}").run(Flow("f", TYPES, [], [report(aggregate=aggregate, retry=RetryPolicy(max_attempts=2))]), seed(spark, ("s", "risk", "1.0")), now=T1)
    assert len(tries) == 2 and result.dead_letters[0][0] == "report" and result.sessions.first().status == "COMPLETED"


def test_undeclared_emissions_are_merged_and_reported(spark, caplog):
    result = Engine(spark).run(Flow("f", TYPES, [operator("x", ("ip",), ("risk",), [("tags", '["a"]')])]), seed(spark, ("s", "ip", '"1"')), now=T1)
    assert result.facts.filter("type = 'tags'").count() == 1
    assert any("does not declare" in r.message for r in caplog.records)


def test_archive_audit_and_replay(spark, tmp_path):
    base = f"file://{tmp_path}"
    vault = Archive(spark, base, TYPES, CipherProvider({"ns_s": b"0123456789abcdef"}))
    flow = Flow("f", TYPES, [operator("scorer", ("email",), ("risk",), [("risk", "0.9")])])
    first = Engine(spark, base, archive=vault, audit=AuditTrail(spark, base)).run(flow, seed(spark, ("s", "work_email", '"a@b"')), now=T1)
    vault.flush(1)
    assert [(r.kind, r.subject, r.outcome) for r in AuditTrail(spark, base).replay("s")] == [("data_point", "work_email", "ADDED"), ("data_point", "risk", "ADDED"), ("operator_run", "scorer", "succeeded")]
    again = introspection.replay(Engine(spark), flow, vault.read(), now=T1)
    assert facts_of(again.facts) == facts_of(first.facts)


def test_introspection(spark):
    flow = Flow("f", TYPES, [operator("a", ("ip",), ("risk",)), operator("b", ("risk", "geo"), ())], completes_when="risk")
    text = introspection.render_text(flow, Engine(spark).run(Flow("g", TYPES), seed(spark, ("s", "ip", '"1"')), now=T1).facts, "s")
    assert text.splitlines() == ["session s, revision 1", "  has 1 ip", "  a is ready", "  b lacks geo", "  b lacks risk", "  not complete"]


def test_small_form(spark):
    sink = MemorySink()
    out = run_session(spark, Flow("f", TYPES, [operator("scorer", ("email",), ("risk",), [("risk", "0.9")])]), seed(spark, ("s", "work_email", '"a"')), sink, now=T1)
    assert {(r.operator_id, r.runs) for r in out.runs.collect()} == {("scorer", 1)} and out.failures.count() == 0
    assert [e[1] for e in sink.events] == ["session_started", "data_point_added", "operator_finished", "data_point_added", "session_finished"]


def wire(kind, value):
    return json.dumps({"type": kind, "value": value, "retrieved_by": "w", "first_retrieved": "2026-01-01T00:00:00", "last_retrieved": "2026-01-01T00:00:00"})


def test_manager(spark, tmp_path):
    now = [1000.0]
    flow = Flow("f", TYPES, [operator("scorer", ("answer",), ("risk",), [("risk", "2.0")], reruns=True)], [report()], completes_when="risk")
    boss = Manager(spark, f"file://{tmp_path}", flow, clock=lambda: now[0], gate_cooldown=5)
    sent = lambda v, i: spark.createDataFrame([("s", wire("answer", v), i)], "session_id string, payload string, seq bigint")
    assert boss.resume("g") is None
    first = boss.start("g", seed(spark, ("s", "ip", '"1"')), now=T1)
    assert first.sessions.first().status == "WAITING"
    with pytest.raises(GateBlockedError):
        boss.start("h", seed(spark, ("s", "ip", '"1"')))
    done = boss.deliver("g", sent("hello", 1), now=T1)
    assert done.sessions.first().status == "COMPLETED" and boss.locks.is_complete("g")
    assert [json.loads(r.document) for r in done.documents.collect()] == [{"risk_count": 1}]
    assert boss.deliver("g", sent("late", 2)) is None
    now[0] += 100
    with pytest.raises(SessionCompleteError):
        boss.start("g", seed(spark, ("s", "ip", '"1"')))
    opened = boss.deliver("g", sent("later", 3), reopen_if_complete=True, now=T1)
    assert sorted(r.value for r in opened.facts.filter("type = 'answer'").collect()) == ['"hello"', '"late"', '"later"']
    assert boss.locks.epoch("g") == 4 and opened.documents.first().version == 2


def test_a_stream_gives_the_batch_answer_and_skips_repeats(spark, tmp_path):
    rows = seed(spark, *[("s", "ip", f'"{i % 3}"', T0 + timedelta(hours=i)) for i in range(12)])
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    store = StreamingStore(spark, f"file://{tmp_path}/out", TYPES)
    q = store.start(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp")
    assert q.awaitTermination(120) and q.exception() is None
    got = sorted((r.value, r.first_retrieved, r.last_retrieved) for r in store.facts.read().collect())
    assert [(v, b) for v, _, b in got] == [(f'"{i}"', T0 + timedelta(hours=9 + i)) for i in range(3)]
    version = store.facts.version()
    store.apply(rows, 0)
    assert store.facts.version() == version


def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_merge_with_state_in_the_query(spark, tmp_path):
    rocks(spark)
    rows = seed(spark, *[("s", "ip", f'"{i % 3}"', T0 + timedelta(hours=i)) for i in range(12)]).withColumn("value_key", F.col("value"))
    rows = rows.withColumn("first_retrieved", F.col("first_retrieved").cast("timestamp")).withColumn("last_retrieved", F.col("last_retrieved").cast("timestamp"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stateful_merge(stream).writeStream.outputMode("update").format("memory").queryName("merged").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None
    total = spark.sql("select sum(added) a, sum(updated) u from merged").first()
    assert (total.a, total.u) == (3, 9)


def test_timers_fire_and_the_query_is_stopped(spark, tmp_path):
    rocks(spark)
    seed(spark, ("s", "ip", '"1"'), ("t", "ip", '"1"')).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SEED).parquet(f"{tmp_path}/in")
    q = session_timers(stream, timedelta(milliseconds=200), timedelta(seconds=1)).writeStream.outputMode("append").format("memory").queryName("timers").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.sql("select count(*) n from timers").first().n < 4:
            time.sleep(1)
    finally:
        q.stop()
    assert {(r.session_id, r.kind) for r in spark.sql("select * from timers").collect()} == {(s, k) for s in "st" for k in ("due", "parked")}
