"""Every stored thing: versions, fences, inbox, durable outputs, archive, audit, leases, effects."""

import json
from datetime import timedelta

import pytest
from helpers import T0, T1, T2, registry, seed
from pyspark.sql import functions as F

from factloom import facts as ops
from factloom.errors import LockHeldError, PiiKeyUnavailableError, StaleEpochError, UnprotectedPiiError, VersionConflictError
from factloom.functions import sealing
from factloom.sources.archive import Archive
from factloom.sources.audit import AuditTrail, merge_rows
from factloom.sources.control import Catalog, EffectRecovery, Effects, Locks, MemorySink, NullSink, TableSink
from factloom.sources.durable import DurableStore
from factloom.sources.inbox import Inbox
from factloom.sources.tables import BucketedTable, VersionedTable

TYPES = registry()


@pytest.fixture
def base(tmp_path):
    return f"file://{tmp_path}"


def test_versions_and_fences(spark, base):
    t = VersionedTable(spark, f"{base}/t", "a bigint")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "a bigint")
    assert t.version() == 0 and t.read().count() == 0
    t.commit(rows(1), epoch=2)
    t.commit(rows(2), epoch=2, append=True)
    assert sorted(r.a for r in t.read().collect()) == [1, 2]
    with pytest.raises(StaleEpochError):
        t.commit(rows(3), epoch=1)
    with pytest.raises(VersionConflictError):
        t.commit(rows(3), epoch=2, expected=1)
    t.commit(rows(9), epoch=5)
    assert t.max_epoch() == 5 and [r.a for r in t.read().collect()] == [9]
    assert sorted(r.a for r in t.read(2).collect()) == [1, 2]
    t.expire(keep=1)
    assert [r.a for r in t.read().collect()] == [9] and t.version() == 3


@pytest.mark.parametrize("epochs", [[1, 2, 1], [2, 1], [1, 1, 2, 1], [2, 2, 1]])
def test_a_lower_epoch_never_writes(spark, base, epochs):
    t = VersionedTable(spark, f"{base}/t", "a bigint")
    top, kept = 0, []
    for i, e in enumerate(epochs):
        if e < top:
            with pytest.raises(StaleEpochError):
                t.commit(spark.createDataFrame([(i,)], "a bigint"), e, append=True)
        else:
            top = e
            kept.append(i)
            t.commit(spark.createDataFrame([(i,)], "a bigint"), e, append=True)
    assert sorted(r.a for r in t.read().collect()) == kept


def payload(kind, value, **more):
    return json.dumps({"type": kind, "value": value, "retrieved_by": "w", "first_retrieved": "2026-01-01T00:00:00", "last_retrieved": "2026-01-01T00:00:00", **more})


def test_inbox(spark, base):
    box = Inbox(spark, base)
    send = lambda *rows: box.append(spark.createDataFrame(list(rows), "session_id string, payload string, seq bigint"))
    send(("s", payload("work_email", "a@b"), 1), ("s", payload("risk", 0.5), 2), ("u", "not json", 3), ("u", '{"value": 1}', 4))
    assert {r.session_id: r.pending for r in box.pending_count().collect()} == {"s": 2, "u": 2}
    assert box.consume(1, 0).count() == 0
    assert {r.seq for r in box.consume(1, 1).collect()} == {1, 3}
    facts = box.drain(TYPES, 1)
    assert sorted((r.type, r.value) for r in facts.collect()) == [("risk", "0.5"), ("work_email", '"a@b"')]
    assert {r.reason for r in box.quarantined().collect()} == {"poison"}
    box.ack(facts.select("entry_id"), 1)
    box.ack(spark.createDataFrame([("unknown",)], "entry_id string"), 1)
    assert box.pending_count().count() == 0
    with pytest.raises(StaleEpochError):
        box.ack(facts.select("entry_id"), 0)


def test_bad_entries_hold_up_no_others_and_are_delivered_again_until_the_cap(spark, base):
    box = Inbox(spark, base)
    rows = [("s", payload("type_from_a_newer_deploy", 1), 1), ("s", payload("risk", 0.5), 2), ("t", payload("risk", "not a number"), 3), ("u", payload("email", "abstract"), 4), ("v", payload("ip", "9"), 5)]
    box.append(spark.createDataFrame(rows, "session_id string, payload string, seq bigint"))
    first = box.drain(TYPES, 1)
    assert sorted((r.session_id, r.type) for r in first.collect()) == [("s", "risk"), ("v", "ip")]
    box.ack(first.select("entry_id"), 1)
    assert box.fresh_count() == 0 and {r.session_id: r.pending for r in box.pending_count().collect()} == {"s": 1, "t": 1, "u": 1}
    for _ in range(4):
        assert box.drain(TYPES, 1).count() == 0
    assert box.quarantined().count() == 0
    assert box.drain(TYPES, 1).count() == 0
    assert sorted((r.session_id, r.reason, r.delivery_count) for r in box.quarantined().collect()) == [(s, "delivered too often", 6) for s in "stu"]
    assert box.pending_count().count() == 0


def test_untouched_buckets_stay(spark, base):
    table = BucketedTable(spark, f"{base}/b", "k string, v bigint", "k", buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v bigint")
    add = lambda new: lambda old: old.unionByName(new)
    first = rows(*[(f"k{i}", i) for i in range(40)])
    table.change(first, 1, add(first))
    before = set(table.manifest()["parts"])
    assert len(before) == 4
    more = rows(("k1", 100))
    table.change(more, 2, add(more), expected=1, note={"batch": 3})
    after = set(table.manifest()["parts"])
    assert len(before & after) == 3 and table.manifest()["batch"] == 3 and table.max_epoch() == 2
    assert sorted(table.read().collect()) == sorted([*first.collect(), *more.collect()])
    with pytest.raises(VersionConflictError):
        table.change(more, 2, add(more), expected=1)
    with pytest.raises(StaleEpochError):
        table.change(more, 1, add(more))
    table.expire(keep=1)
    assert table.read().count() == 41
    assert BucketedTable(spark, f"{base}/b", "k string, v bigint", "k", buckets=9).buckets() == 4


def docs(spark, *rows):
    return spark.createDataFrame([("t", k, d, s, T0) for k, d, s in rows], "table_name string, key string, document string, status string, updated_at timestamp_ntz")


def test_durable_documents(spark, base):
    store = DurableStore(spark, base)
    store.upsert(docs(spark, ("a", "1", "in_progress"), ("b", "1", "final")), 1)
    store.upsert(docs(spark, ("a", "2", "final"), ("b", "2", "in_progress")), 1)
    assert sorted((r.key, r.document, r.version, r.status) for r in store.read("t").collect()) == [("a", "2", 2, "final"), ("b", "1", 1, "final")]
    expect = lambda v: spark.createDataFrame([("t", "a", v)], "table_name string, key string, version bigint")
    with pytest.raises(VersionConflictError):
        store.upsert(docs(spark, ("a", "3", "final")), 4, expect(1))
    assert store.documents.max_epoch() == 4  # recorded all the same
    with pytest.raises(StaleEpochError):
        store.upsert(docs(spark, ("a", "3", "final")), 3, expect(2))
    store.upsert(docs(spark, ("a", "3", "final")), 4, expect(2))
    assert store.read("t", "a").first().version == 3


def test_sets_and_contributions(spark, base):
    store = DurableStore(spark, base)
    rows = lambda *m: spark.createDataFrame([("t", "k", "f", x) for x in m], "table_name string, key string, field string, member string")
    assert store.add_to_set(rows("a", "b", "a"), 1).first().cardinality == 2
    assert store.add_to_set(rows("b", "c"), 1).first().cardinality == 3
    pairs = spark.createDataFrame([("s", "x"), ("s", "x"), ("u", "x")], "session_id string, operator_id string")
    store.mark_contributions(pairs.filter("session_id = 's'"), 1)
    assert [r.session_id for r in store.unmarked(pairs).collect()] == ["u"]
    store.mark_contributions(pairs, 2)
    assert store.marks.read().count() == 2
    store.clear_contributions(spark.createDataFrame([("s",)], "session_id string"), 2)
    assert [r.session_id for r in store.marks.read().collect()] == ["u"]


KEY = b"0123456789abcdef"


def test_archive_reads_the_same_before_and_after_a_flush(spark, base):
    ciphers = sealing.CipherProvider({"ns_s": KEY})
    box = Archive(spark, base, TYPES, ciphers, retention=timedelta(hours=1))
    rows = seed(spark, ("s", "work_email", '"a"', T1), ("s", "risk", "1.0", T0), ("s", "trigger", '"x"', T0), ("s", "risk", "1.0", T2)).withColumn("value_key", TYPES.value_keys())
    box.archive(rows, 1)
    view = lambda: [(r.type, r.value, r.first_retrieved, r.last_retrieved) for r in box.read().collect()]
    before = view()
    assert before == [("risk", "1.0", T0, T2), ("work_email", '"a"', T1, T1)]
    assert '"a"' not in [r.value for r in box.read(unseal=False).collect()]
    assert box.flush(1) == 3 and box.buffered_count() == 0
    assert view() == before
    box.archive(rows, 2)
    assert view() == before
    live = lambda t: {r.type for r in box.read(F.lit(t).cast("timestamp_ntz")).collect()}
    assert live(T2) == {"risk", "work_email"}
    assert live(T2 + timedelta(seconds=1)) == {"risk"}
    with pytest.raises(StaleEpochError):
        box.archive(rows, 0)


def test_personal_data_needs_a_key(spark, base):
    rows = seed(spark, ("s", "work_email", '"a"')).withColumn("value_key", TYPES.value_keys())
    with pytest.raises(UnprotectedPiiError):
        Archive(spark, base, TYPES).archive(rows, 1)
    Archive(spark, base, TYPES, sealing.CipherProvider({"ns_s": KEY})).archive(rows, 1)
    with pytest.raises(PiiKeyUnavailableError):
        Archive(spark, base, TYPES).read()


def test_hashes_differ_by_session_and_are_repeatable(spark):
    ciphers = sealing.CipherProvider({"ns_s": KEY, "ns_u": KEY})
    rows = seed(spark, ("s", "ip", '"a"'), ("u", "ip", '"a"'), ("s", "risk", "1.0"), ("u", "risk", "1.0")).withColumn("value_key", TYPES.value_keys())
    one = {(r.session_id, r.type): r.value_hash for r in sealing.seal_facts(rows, TYPES, ciphers).collect()}
    two = {(r.session_id, r.type): r.value_hash for r in sealing.seal_facts(rows, TYPES, ciphers).collect()}
    assert one == two and one["s", "ip"] != one["u", "ip"] and one["s", "risk"] == one["u", "risk"]


def test_audit_sequences_and_coalescing(spark, base):
    trail = AuditTrail(spark, base)
    rows = seed(spark, ("s", "risk", "1.0", T0), ("s", "risk", "1.0", T1), ("s", "trigger", '"x"', T0), ("s", "ip", '"a"', T0)).withColumn("value_key", TYPES.value_keys())
    seen = ops.outcomes(rows)
    trail.append(merge_rows(seen, TYPES, 1), 1)
    trail.append(merge_rows(seen, TYPES, 1), 1)
    got = list(trail.replay("s"))
    assert [r.sequence for r in got] == list(range(1, 9))
    assert {(r.kind, r.subject, r.outcome, r.detail, r.n) for r in got} == {
        ("data_point", "ip", "ADDED", "<redacted>", 1), ("data_point", "risk", "ADDED", "1.0", 1), ("data_point_summary", "risk", None, "re-observed", 1), ("data_point_summary", "trigger", None, "merged", 1),
    }
    with pytest.raises(StaleEpochError):
        trail.append(merge_rows(seen, TYPES, 0), 0)


def test_redaction(spark):
    df = spark.sql("select map('a', '1', 'b', cast(null as string)) as m, 'pending:7' as s, 'pending:x' as t, 'committed' as u")
    r = df.select(sealing.redact_parameters(F.col("m")), *[sealing.pending_epoch(F.col(c)) for c in "stu"]).first()
    assert r[0] == {"a": "<redacted>", "b": "<redacted>"} and r[1:] == (7, None, None)


def test_leases(spark, base):
    now = [100.0]
    locks = Locks(spark, base, ttl=10, clock=lambda: now[0])
    first = locks.acquire("s")
    with pytest.raises(LockHeldError):
        locks.acquire("s")
    assert not locks.is_orphaned("s") and not locks.is_orphaned("never")
    now[0] = 105
    locks.renew("s", first)
    now[0] = 112
    assert locks.is_held("s")
    now[0] = 116
    assert locks.is_orphaned("s")
    second = locks.acquire("s")
    assert second > first
    with pytest.raises(StaleEpochError):
        locks.renew("s", first)
    locks.mark_complete("s", second)
    locks.release("s", second)
    assert locks.is_complete("s") and not locks.is_orphaned("s") and locks.epoch("s") == second


def test_effects_happen_once(spark, base):
    fx = Effects(spark, base)
    done = []
    for op in ("a", "a", "b"):
        with fx.once("s", op, "mail", 1) as go:
            if go:
                done.append(op)
    assert done == ["a", "b"] and fx.state("s", "a", "mail") == "committed"  # one key of two operators is two effects
    with pytest.raises(RuntimeError), fx.once("s", "a", "bad", 1) as go:
        assert go
        raise RuntimeError
    with fx.once("s", "a", "bad", 1) as go:
        assert go
    fx._put("s", "a", "lost", "pending:1")
    with fx.once("s", "a", "lost", 2, EffectRecovery.SKIP) as go:
        assert not go
    with fx.once("s", "a", "lost", 2) as go:
        assert go
    fx._put("s", "a", "newer", "pending:9")
    with pytest.raises(StaleEpochError), fx.once("s", "a", "newer", 2):
        pass


def test_a_lease_is_renewed_while_a_run_lasts(spark, base):
    import time

    locks = Locks(spark, base, ttl=0.6)
    epoch = locks.acquire("s")
    with locks.kept("s", epoch) as lost:
        time.sleep(1.5)
        assert locks.is_held("s") and not lost.is_set()
    locks.release("s", epoch)
    assert not locks.is_held("s") and len(locks.files.names("s")) <= 2 and locks.epoch("s") == epoch


def test_catalog_and_sinks(spark, base):
    c = Catalog(operators={"a": None, "b": {"x"}, "c": set()}, credentials={("a", "cap"): {"k": 1}})
    got = c.credentials_for("a", "cap")
    got["k"] = 2
    assert c.credentials_for("a", "cap") == {"k": 1} and c.credentials_for("b", "cap") == {}
    assert sorted(tuple(r) for r in c.grants(spark, "operators", "operator_id").collect()) == [("a", None), ("b", "x")]
    events = spark.createDataFrame([("s", "session_started", None, None, None, 0)], "session_id string, kind string, subject string, outcome string, detail string, seq bigint")
    NullSink().publish(events)
    memory, table = MemorySink(), TableSink(spark, base)
    memory.publish(events)
    table.publish(events)
    table.publish(events)
    assert len(memory.events) == 1 and table.table.read().count() == 2
