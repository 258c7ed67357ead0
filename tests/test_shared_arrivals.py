"""Events that share their place in the order of arrival, as they do in tables of more than 1,000,003 events."""

from collections import Counter
from datetime import timedelta

import duckdb
import pytest
from helpers import T0, registry
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factloom.sources.inbox import Inbox

PRIME = 1_000_003
TYPES = registry()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two users of 60 events; ids that are a prime apart share their place. The later id comes first in time, by its columns and in the table."""
    base = str(tmp_path_factory.mktemp("shared"))
    rows = [(i + k * PRIME, T0 + timedelta(hours=60 * (3 - k) + i), i % 2, ("view", "click")[(i // 2 + (k == 2 and i >= 30)) % 2], float(10 * (i // 30))) for i in range(40) for k in (2, 1, 0)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").coalesce(1).write.parquet(f"{base}/events.parquet")
    return base


def by_sql(folder, sql):
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        return Counter(c.sql(sql).fetchall())


def by_query(spark, folder, name):
    return Counter(tuple(r) for r in entry.queries()[name](spark, folder).collect())


@pytest.mark.parametrize("name", ["inbox_drain", "delivery_cap_quarantine", "inbox_bounded_consume", "inbox_pending", "inbox_redelivery"])
def test_inboxes_hold_every_entry_once(spark, folder, name):
    assert by_query(spark, folder, name) == by_sql(folder, entry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["audit_sequence", "keyed_merge", "merge_outcomes", "streaming_merge"])
def test_events_that_share_their_place_come_by_id(spark, folder, name):
    """The SQL leaves these ties open, so it is held to one order here."""
    sql = entry.oracle_sql()[name].replace(", seq)", ", (seq, event_id))").replace("ORDER BY seq)", "ORDER BY seq, event_id)")
    assert by_query(spark, folder, name) == by_sql(folder, sql)


def test_entries_that_share_the_last_claimed_place_come_by_id(spark, tmp_path):
    """Of five entries of one place three are claimed; the SQL leaves open which, so it is held to one order here."""
    rows = [(i + k * PRIME, T0 + timedelta(hours=i + k), i, "view", float(10 * k)) for i in range(40) for k in (4, 3, 2, 1, 0)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    sql = entry.oracle_sql()["inbox_redelivery"].replace("ORDER BY seq)", "ORDER BY seq, event_id)")
    assert by_query(spark, str(tmp_path), "inbox_redelivery") == by_sql(str(tmp_path), sql)


def test_places_are_kept_whatever_the_ids(spark, tmp_path):
    rows = [(i, T0 + timedelta(hours=n), n % 2, "view", 10.0) for n, i in enumerate((-5, -3, 4, 7, (1 << 40) + 1, (1 << 41) + 2))]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert by_query(spark, str(tmp_path), "inbox_bounded_consume") == by_sql(str(tmp_path), entry.oracle_sql()["inbox_bounded_consume"])


def test_entries_of_one_sequence_are_told_apart(spark, tmp_path):
    """Within an append and across appends, and even if they are equal."""
    box = Inbox(spark, f"file://{tmp_path}")
    send = lambda *p: box.append(spark.createDataFrame([("s", x, 1) for x in p], "session_id string, payload string, seq bigint"))
    send('{"type":"risk","value":1}', '{"type":"risk","value":2}', '{"type":"risk","value":2}')
    send('{"type":"risk","value":1}')
    assert box.pending_count().first().pending == 4
    assert box.consume(1, 3).count() == 3
    facts = box.drain(TYPES, 1)
    assert sorted(r.value for r in facts.collect()) == ["1", "1", "2", "2"]
    box.ack(facts.filter("value = '1'").select("entry_id"), 1)
    assert sorted(r.payload[-2] for r in box.reclaim(1).collect()) == ["2", "2"]
    assert box.entries.read().select(F.count_distinct("entry_id")).first()[0] == 4
