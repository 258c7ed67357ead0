"""Graphs, readiness, completion, schedules."""

import sys
import types as pytypes
import zlib
from datetime import timedelta

import pytest
from helpers import T0, Capability, OperatorPolicy, operator, registry, seed
from pyspark.sql import functions as F

from factloom import cli
from factloom.errors import CapabilityUnavailableError, DuplicateIdError, InvalidConditionError, MissingPolicyError, UnauditedActionError, UnboundedCycleError
from factloom.flow import Flow
from factloom.operators.activation import Activator, TokenBucket
from factloom.operators.base import ActionSeam, Aggregator, CapabilityView, Operator, action
from factloom.plans import completion, graph, readiness, scheduling

TYPES = registry()
A = operator("a", ("ip",), ("email",))
B = operator("b", ("work_email",), ("risk",))
C = operator("c", ("risk",), ("ip",))
D = operator("d", ("risk",), ("tags",))


def test_declarations_are_checked():
    with pytest.raises(MissingPolicyError):
        type("bad", (Operator,), {"operator_id": "bad"})
    with pytest.raises(UnauditedActionError):
        type("cap", (Capability,), {"fetch": lambda self: None})
    fine = type("cap", (Capability,), {"fetch": action("slow")(lambda self: None)})
    assert fine.capability_id == "cap" and fine.fetch.rate_limit == "slow"
    with pytest.raises(DuplicateIdError):
        Flow("f", TYPES, [B, operator("b")])


def test_edges_and_cycles():
    edges = graph.build_edges([A, B, D], TYPES)
    assert edges == {"a": {"b"}, "b": {"d"}, "d": set()}
    assert graph.effective_produces(A, TYPES) == {"work_email", "personal_email"}
    with pytest.raises(UnboundedCycleError):
        graph.validate([A, B, C], TYPES)
    bounded = [operator(x.operator_id, x.depends_on, x.produces, max_cycles=2) for x in (A, B, C)]
    assert graph.find_cycles(graph.validate(bounded, TYPES)) == [["a", "b", "c"]]
    own = operator("own", ("risk",), ("risk",))
    with pytest.raises(UnboundedCycleError):
        graph.validate([own], TYPES)
    x = type("x", (Capability,), {"kinds": ("k1",), "requires": ("k2",)})
    y = type("y", (Capability,), {"kinds": ("k2",), "requires": ("k1",)})
    with pytest.raises(UnboundedCycleError):
        graph.validate([x, y], TYPES)


def test_weak_edges_skip_the_operator_itself():
    u = operator("u", ("ip",), ("risk",), uses=("risk",))
    assert graph.build_uses_edges([u, B], TYPES) == {"u": set(), "b": {"u"}}


def test_either_direction_in_the_small_form():
    leaf = operator("leaf", ("ip",), ("work_email",))
    broad = operator("broad", ("ip",), ("email",))
    narrow = operator("narrow", ("work_email",), ())
    assert graph.build_edges([broad, narrow, leaf], TYPES, both_ways=True) == {"broad": {"narrow"}, "narrow": set(), "leaf": {"narrow"}}


def test_reachability_follows_dependencies_only():
    helper = operator("helper", (), ("tags",))
    user = operator("user", ("work_email",), ("risk",), uses=("tags",))
    assert graph.backward_reachable([A, user, helper, D], TYPES, ["risk"]) == {"a", "user"}
    net = type("net", (Capability,), {"kinds": ("net",), "requires": ("auth",)})
    auth = type("auth", (Capability,), {"kinds": ("auth",)})
    needs = operator("needs", (), ("risk",), requires=("net",))
    assert graph.backward_reachable([needs, net, auth], TYPES, ["risk"]) == {"needs", "net", "auth"}


def test_pruning_only_if_something_consumes():
    report = type("report", (Aggregator,), {"policy": OperatorPolicy(rerun_on_new_data=False), "depends_on": ("risk",), "consumes": ("risk",)})
    quiet = type("quiet", (Aggregator,), {"policy": OperatorPolicy(rerun_on_new_data=False), "depends_on": ("risk",)})
    assert [x.operator_id for x in Flow("f", TYPES, [A, B, D], [report]).pruned] == ["a", "b"]
    assert [x.operator_id for x in Flow("f", TYPES, [A, B, D], [quiet]).pruned] == ["a", "b", "d"]


def test_fingerprints():
    f = Flow("f", TYPES, [A, B]).fingerprint()
    assert f == Flow("g", TYPES, [B, A]).fingerprint()
    assert f != Flow("f", TYPES, [A, B, D]).fingerprint()
    assert f == Flow("f", TYPES, [operator("a", ("ip",), ("email",), uses=("tags",), timeout=timedelta(1)), B]).fingerprint()
    assert Flow("f", TYPES, [A]).drifted(f) and not Flow("f", TYPES, [A, B]).drifted(f) and not Flow("f", TYPES, [A]).drifted(None)


def test_pictures_and_the_command(capsys):
    odd = operator("a-b c", ("ip",), ("risk",))
    text = graph.mermaid([odd, D], TYPES)
    assert text == graph.mermaid([D, odd], TYPES)
    assert "a_b_c[a-b c]" in text and "a_b_c --> d" in text
    module = pytypes.ModuleType("flow_for_test")
    module.good = Flow("f", TYPES, [A, B])
    module.bad = lambda: Flow("f", TYPES, [A, B, C])
    sys.modules["flow_for_test"] = module
    assert cli.main(["flow_for_test:good", "--check", "--mermaid"]) == 0
    assert "flowchart" in capsys.readouterr().out
    assert cli.main(["flow_for_test:bad", "--check"]) == 1
    assert cli.main(["flow_for_test:none"]) == 2
    assert cli.main(["no_such_module:x"]) == 2


def test_providers():
    view = CapabilityView({"z": ("k",), "a": ("k",), "m": ("k", "j")}, preferred=("m",))
    assert view.resolve("k") == ["m", "a", "z"] and view.require("j") == "m"
    with pytest.raises(Exception, match="nothing provides"):
        view.require("none")


def test_readiness_by_subtype(spark):
    facts = seed(spark, ("s1", "work_email", '"x"'), ("s2", "ip", '"x"'))
    wants = readiness.declared(spark, [operator("e", ("email",)), operator("both", ("email", "ip"))], "depends_on")
    ids = spark.createDataFrame([("e",), ("both",), ("free",)], "operator_id string")
    have = readiness.present_ancestors(facts, TYPES)
    got = {tuple(r) for r in readiness.ready(facts, have, wants, ids).collect()}
    assert got == {("s1", "e"), ("s1", "free"), ("s2", "free")}
    gap = {tuple(r) for r in readiness.readiness_gap(facts, have, wants).collect()}
    assert gap == {("s1", "both", "ip"), ("s2", "e", "email"), ("s2", "both", "email")}
    nodes = [A, B, operator("never", ("geo",)), operator("caps", (), requires=("net",))]
    pending = facts.filter("session_id = 's2'").withColumn("operator_id", F.explode(F.array(*[F.lit(x.operator_id) for x in nodes])))
    reach = lambda **k: {r.operator_id for r in readiness.reachable_pending(have, facts, pending, nodes, TYPES, **k).collect()}
    assert reach() == {"a", "b", "caps"}
    assert reach(provided=spark.createDataFrame([], "session_id string, wanted string")) == {"a", "b"}
    assert [tuple(r) for r in readiness.by_name(readiness.readiness_gap(facts, have, wants)).filter("session_id = 's2' and operator_id = 'both'").collect()] == [("s2", "both", ["email"])]
    now, seen = (spark.createDataFrame(rows, "session_id string, capability_id string") for rows in ([("s", "a"), ("s", "b"), ("t", "a")], [("s", "a")]))
    assert sorted(tuple(r) for r in readiness.newly_available(now, seen).collect()) == [("s", "b"), ("t", "a")]


def test_completion(spark):
    facts = seed(spark, ("s1", "work_email", '"x"'), ("s1", "risk", "1.0"), ("s2", "ip", '"x"'))
    sat = lambda c: {r.session_id: r.satisfied for r in completion.satisfied(facts, facts, c, TYPES).collect()}
    assert sat("email") == {"s1": True, "s2": False}
    assert sat(completion.all_of()) == {"s1": True, "s2": True}
    assert sat(completion.any_of()) == {"s1": False, "s2": False}
    assert sat(completion.all_of("email", completion.any_of("geo", "risk"))) == {"s1": True, "s2": False}
    many = lambda f: f.groupBy("session_id").agg((F.count("type") > 1).alias("satisfied"))
    assert sat(completion.any_of("ip", many)) == {"s1": True, "s2": True}
    assert completion.describe(completion.all_of("a", completion.any_of("b"))) == "all(present(a), any(present(b)))"
    assert completion.referenced_types(completion.all_of("a", completion.any_of("b"))) == {"a", "b"}
    assert completion.referenced_types(completion.any_of("a", many)) is None
    with pytest.raises(InvalidConditionError):
        completion.normalize(5)


def at(*seconds):
    return [("k", T0 + timedelta(seconds=s), i) for i, s in enumerate(seconds)]


def run(f, spark, rows, *args):
    return [(r[1] - T0).total_seconds() for r in f(spark.createDataFrame(rows, "k string, ts timestamp_ntz, o bigint"), "k", "ts", *args).collect()]


def test_debounce_is_fixed_and_takes_its_last_instant(spark):
    assert sorted(run(scheduling.debounce_runs, spark, at(0, 5, 10, 11, 30), timedelta(seconds=10))) == [10, 21, 40]
    assert sorted(run(scheduling.debounce_runs, spark, at(0, 0, 3), timedelta(0))) == [0, 3]


def test_cooldown_accepts_at_expiry(spark):
    assert sorted(run(scheduling.cooldown_gate, spark, at(0, 5, 10, 11, 30), timedelta(seconds=10))) == [0, 10, 30]


def test_park_is_beaten_by_an_arrival_at_the_same_instant(spark):
    assert run(scheduling.park_points, spark, at(0, 10, 21), timedelta(seconds=10)) == [20]


def test_token_bucket_against_a_loop(spark):
    rows = at(0, 0, 0, 1, 1, 5, 30)
    df = scheduling.token_bucket(spark.createDataFrame(rows, "k string, ts timestamp_ntz, o bigint"), "k", "ts", 2.0, 0.5, "o")
    got = [(r.admitted_at - T0).total_seconds() for r in df.orderBy("o").collect()]
    tokens, now, want = 2.0, 0.0, []
    for _, t, _ in rows:
        t = max((t - T0).total_seconds(), now)
        tokens = min(2.0, tokens + (t - now) * 0.5)
        wait = 0.0 if tokens >= 1 else (1 - tokens) / 0.5
        tokens = tokens - 1 if tokens >= 1 else 0.0
        now = t + wait
        want.append(now)
    assert got == pytest.approx(want, abs=1e-4)


def test_retry_delays_are_seeded(spark):
    rows = spark.range(1, 5).select(F.col("id").alias("n"), scheduling.seed_of(F.lit("s"), F.lit("op"), F.col("id").cast("string")).alias("seed"))
    delay = lambda jitter: scheduling.retry_delay(F.col("n"), F.lit(1_000_000), F.lit(2.0), F.lit(jitter), F.col("seed"))
    got = rows.select("seed", delay(0.0).alias("plain"), delay(0.2).alias("off")).collect()
    assert [r.plain for r in got] == [1_000_000, 2_000_000, 4_000_000, 8_000_000]
    assert [r.seed for r in got] == [zlib.crc32(f"s|op|{k}".encode()) for k in range(1, 5)]
    assert all(0 < abs(r.off - r.plain) <= 0.2 * r.plain for r in got)


def test_an_interim_window_defers_to_completion(spark):
    windows = spark.createDataFrame([("s", "op", False, T0), ("s", "agg", True, T0), ("t", "agg", True, T0)], "session_id string, operator_id string, interim boolean, due_at timestamp_ntz")
    done = spark.createDataFrame([("s", True), ("t", False)], "session_id string, satisfied boolean")
    assert sorted((r.session_id, r.operator_id) for r in scheduling.holding_windows(windows, done).collect()) == [("s", "op"), ("t", "agg")]


def test_pruning_keeps_what_completion_waits_for():
    report = type("r", (Aggregator,), {"operator_id": "r", "policy": OperatorPolicy(rerun_on_new_data=False), "consumes": ("risk",)})
    a, c, idle = operator("a", ("ip",), ("risk",)), operator("c", ("ip",), ("geo",)), operator("idle", ("ip",), ("tags",))
    kept = lambda **k: [x.operator_id for x in Flow("f", TYPES, [a, c, idle], [report], **k).pruned]
    assert kept() == ["a"] and kept(completes_when="geo") == ["a", "c"] and kept(completes_when=lambda facts: facts) == ["a", "c", "idle"]


def test_actions_are_audited_and_limited():
    class Mail(Capability):
        def activate(self, credentials):
            self.sent = []

        @action("mails")
        def send(self, to, text="x"):
            self.sent.append(to)
            return len(self.sent)

        @action()
        def fail(self):
            raise ValueError("no")

    waits, now = [], [0.0]
    mail = Mail()
    mail.activate({})
    with pytest.raises(UnauditedActionError):
        mail.send("a")
    seam = ActionSeam("ns", "s", TokenBucket(1.0, 0.5, clock=lambda: now[0], sleep=waits.append))
    bound = mail.bind(seam)
    assert [bound.send("a"), bound.send("b", text="secret"), bound.send("c")] == [1, 2, 3]
    with pytest.raises(ValueError, match="no"):
        bound.fail()
    assert waits == [2.0, 4.0]
    assert [r[2:] for r in seam.rows] == [("Mail.send", "succeeded", '{"to": "<redacted>"}'), ("Mail.send", "succeeded", '{"text": "<redacted>", "to": "<redacted>"}'), ("Mail.send", "succeeded", '{"to": "<redacted>"}'), ("Mail.fail", "failed", "{}")]


def test_activation_cools_off_and_gives_up():
    tries = []

    class Base(Capability):
        kinds = ("base",)

        def activate(self, credentials):
            tries.append(("Base", credentials.get("k")))
            if credentials.get("bad"):
                raise OSError("down")

    class Layer(Capability):
        kinds = ("layer",)
        requires = ("base",)

        def activate(self, credentials):
            tries.append(("Layer", None))

    on = Activator([Layer(), Base()], lambda ns, cap: {"k": ns, "bad": ns == "b"}, max_attempts=2, cool_off=timedelta(seconds=10))
    wanted = {(n, c) for n in "ab" for c in ("Base", "Layer")}
    told = on.refresh(T0, wanted)
    assert [x[:3] for x in told] == [("a", "Base", "activated"), ("b", "Base", "failed"), ("a", "Layer", "activated")]
    assert on.next_try(wanted) == T0 + timedelta(seconds=10)
    assert on.refresh(T0 + timedelta(seconds=9), wanted) == []
    assert [x[:3] for x in on.refresh(T0 + timedelta(seconds=10), wanted)] == [("b", "Base", "given_up")]
    assert on.refresh(T0 + timedelta(days=1), wanted) == [] and tries.count(("Base", "b")) == 2 and tries.count(("Base", "a")) == 1
    assert on.instance("a", "Layer") is on.instance("a", "Layer") and on.next_try(wanted) is None
    with pytest.raises(CapabilityUnavailableError):
        on.instance("b", "Layer")
