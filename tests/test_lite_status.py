"""The lite query reports the status that the run gives."""

from pyspark.sql import functions as F

from factloom import lite, queries


def test_status_comes_from_the_run(spark, monkeypatch):
    rows = [("a", 2), ("b", 1)]
    points = spark.createDataFrame([(s,) for s, n in rows for _ in range(n)], "session_id string")
    events = spark.createDataFrame([("a", "session_finished", "PARKED"), ("b", "session_finished", "COMPLETED"), ("a", "session_started", None)], "session_id string, kind string, outcome string")
    monkeypatch.setattr(queries, "_seed", lambda *_: None)
    monkeypatch.setattr(lite, "run_session", lambda *_, **__: lite.SessionResult(points, None, None, events=events))
    got = {r.session_id: (r.n_facts, r.status) for r in queries.lite_session_result(spark, "").collect()}
    assert got == {"a": (2, "PARKED"), "b": (1, "COMPLETED")}


def test_whole_query(spark):
    got = queries.lite_session_result(spark, "/root/testdata/sf0.001")
    assert [r.status for r in got.select("status").distinct().collect()] == ["COMPLETED"]
    assert got.filter(F.col("n_facts").isNull()).count() == 0
