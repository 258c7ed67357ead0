"""Types, identity, merge, revisions, deltas."""

import random

import pytest
from helpers import T0, T1, T2, registry, seed
from pyspark.sql import functions as F

from factloom import facts as ops
from factloom.errors import DuplicateIdError, InvalidPayloadError, InvalidTypeError, UnknownTypeError
from factloom.types import FACT_DDL, TypeConfig, TypeRegistry, typed, value_key


def test_definitions_are_checked():
    types = registry()
    assert types.leaves("email") == ["personal_email", "work_email"]
    assert types.leaves("ip") == ["ip"]
    assert types.matches("work_email", "email") and not types.matches("email", "work_email")
    with pytest.raises(DuplicateIdError):
        types.define("ip", config=TypeConfig())
    with pytest.raises(InvalidTypeError):
        types.define("loose")
    with pytest.raises(InvalidTypeError):
        types.define("child", "nobody", config=TypeConfig())
    with pytest.raises(InvalidTypeError):
        types.emittable("email")
    with pytest.raises(UnknownTypeError):
        types.leaves("nothing")


@pytest.mark.parametrize(
    ("ddl", "is_set", "same", "other"),
    [
        ("map<string,double>", False, ('{"a":1.0,"b":2.0}', '{"b":2.0,"a":1.0}'), '{"a":1.0}'),
        ("array<string>", False, ('["a","b"]', '["a","b"]'), '["b","a"]'),
        ("array<string>", True, ('["a","b","a"]', '["b","a"]'), '["a"]'),
        ("map<string,array<string>>", False, ('{"x":["1"],"y":[]}', '{"y":[],"x":["1"]}'), '{"x":[],"y":["1"]}'),
        ("double", False, ("0.0", "-0.0"), "1.0"),
        ("bigint", False, ("5", "5"), "6"),
        ("string", False, ('"é \\"q\\""', '"é \\"q\\""'), '""'),
    ],
)
def test_value_keys(spark, ddl, is_set, same, other):
    df = spark.createDataFrame([(x,) for x in (*same, other)], "v string")
    a, b, c = [r[0] for r in df.select(value_key(typed(F.col("v"), ddl), ddl, is_set)).collect()]
    assert a == b != c


def test_strict_parsing(spark):
    types = registry()
    good = types.parse(seed(spark, ("s", "risk", "0.5"), ("s", "geo", '{"x":1.0}')))
    assert good.filter("value_key is null").count() == 0
    with pytest.raises(UnknownTypeError):
        types.parse(seed(spark, ("s", "newer", "1")))
    with pytest.raises(InvalidPayloadError):
        types.parse(seed(spark, ("s", "risk", '"high"')))


def plain_merge(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["ins_seq"]):
        k = (r["session_id"], r["type"], r["value"])
        if k not in out:
            out[k] = [r["retrieved_by"], r["first_retrieved"], r["last_retrieved"]]
        else:
            out[k][2] = max(out[k][2], r["last_retrieved"])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("deal", range(3))
def test_batches_equal_one_merge_in_any_split(spark, deal):
    rng = random.Random(deal)
    times = [T0, T1, T2]
    rows = [{"session_id": f"s{rng.randrange(3)}", "namespace_id": "n", "type": "ip", "value": f'"{rng.randrange(4)}"', "retrieved_by": f"op{i}", "first_retrieved": (t := rng.choice(times)), "last_retrieved": t, "ins_seq": i} for i in range(40)]
    schema = "session_id string, namespace_id string, type string, value string, retrieved_by string, first_retrieved timestamp_ntz, last_retrieved timestamp_ntz, ins_seq bigint"
    state = spark.createDataFrame([], FACT_DDL)
    revision, stamps = {}, {}
    for lo in range(0, 40, 10):
        batch = rows[lo : lo + 10]
        before = plain_merge(rows[:lo])
        after = plain_merge(rows[: lo + 10])
        for s in {k[0] for k in after}:
            changed = [k for k in after if k[0] == s and (k not in before or after[k][2] > before[k][2])]
            if changed:
                revision[s] = revision.get(s, 0) + 1
            for k in changed:
                stamps[k] = (stamps[k][0] if k in before else revision[s], revision[s])
        df = spark.createDataFrame(batch, schema).withColumn("value_key", F.col("value"))
        state = spark.createDataFrame(ops.apply_batch(state, df, ops.revisions(state)).collect(), FACT_DDL)
    want = plain_merge(rows)
    got = {(r.session_id, r.type, r.value): r for r in state.collect()}
    assert {k: (r.retrieved_by, r.first_retrieved, r.last_retrieved) for k, r in got.items()} == want
    assert {k: (r.added_rev, r.updated_rev) for k, r in got.items()} == stamps
    assert {r.session_id: r.revision for r in ops.revisions(state).collect()} == revision
    whole = spark.createDataFrame(rows, schema).withColumn("value_key", F.col("value")).withColumn("added_rev", F.lit(0).cast("bigint")).withColumn("updated_rev", F.lit(0).cast("bigint"))
    assert {(r.session_id, r.type, r.value): (r.retrieved_by, r.first_retrieved, r.last_retrieved) for r in ops.merge(whole).collect()} == want


def test_an_older_observation_changes_nothing(spark):
    types = registry()
    keyed = lambda df: df.withColumn("value_key", types.value_keys())
    state = spark.createDataFrame([], FACT_DDL)
    for row in (("s", "ip", '"1"', T1), ("s", "ip", '"1"', T0), ("s", "ip", '"1"', T1)):
        state = ops.apply_batch(state, keyed(seed(spark, row)), ops.revisions(state))
    r = state.first()
    assert (r.first_retrieved, r.last_retrieved, r.added_rev, r.updated_rev) == (T1, T1, 1, 1)
    state = ops.apply_batch(state, keyed(seed(spark, ("s", "ip", '"1"', T2))), ops.revisions(state))
    r = state.first()
    assert (r.first_retrieved, r.last_retrieved, r.added_rev, r.updated_rev) == (T1, T2, 1, 2)
    assert [x.change for x in ops.change_set_since(state, 1).collect()] == ["updated"]
    assert [x.change for x in ops.change_set_since(state, 0).collect()] == ["added"]
    assert ops.change_set_since(state, 2).count() == 0


def test_latest_ties_go_to_the_first_arrival(spark):
    df = seed(spark, ("s", "ip", '"a"', T1), ("s", "ip", '"b"', T1), ("s", "risk", "1.0", T0))
    assert [r.value for r in ops.latest(df.filter("type = 'ip'")).collect()] == ['"a"']
    assert ops.latest(df.filter("type = 'geo'")).count() == 0
    assert {r.type for r in ops.latest(df, "type").collect()} == {"ip", "risk"}
    assert ops.of_type(df, registry(), "email").count() == 0


def test_registry_versions_move():
    types = TypeRegistry()
    types.define("a", config=TypeConfig())
    v = types.version
    types.define("b", config=TypeConfig())
    assert types.version > v and "b" in types and types.flagged("pii") == []
