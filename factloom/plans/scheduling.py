"""Rules over arrival times: debounce, cooldown, token bucket, backoff, deadline, park.

Debounce, cooldown and token bucket decide each arrival by the decisions before it, so each is a fold over a key's sorted arrivals. A fold
keeps one key's distinct instants in one row: sessions and capabilities are keys, and each of them has a bounded life.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.base import RetryPolicy


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _time(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def _us(d: timedelta) -> int:
    return d // timedelta(microseconds=1)


def debounce_runs(arrivals: DataFrame, key: str, ts: str, window: timedelta) -> DataFrame:
    """(key, due): the first arrival arms ``due = first + window``; arrivals up to and at ``due`` join that run; the next one after it arms
    anew. A fixed window that does not slide. With a window of 0 every instant is a run."""
    w = F.lit(_us(window)).cast("long")
    start = F.struct(F.lit(None).cast("long").alias("due"), F.expr("cast(array() as array<bigint>)").alias("runs"))

    def step(acc: Column, t: Column) -> Column:
        new = acc["due"].isNull() | (t > acc["due"])
        return F.struct(F.when(new, t + w).otherwise(acc["due"]).alias("due"), F.when(new, F.concat(acc["runs"], F.array(t + w))).otherwise(acc["runs"]).alias("runs"))

    folded = arrivals.groupBy(key).agg(F.array_sort(F.collect_set(_micros(F.col(ts)))).alias("_t"))
    return folded.select(key, F.explode(F.aggregate("_t", start, step, lambda acc: acc["runs"])).alias("_due")).select(key, _time(F.col("_due")).alias("due"))


def cooldown_gate(arrivals: DataFrame, key: str, ts: str, cooldown: timedelta) -> DataFrame:
    """(key, accepted_at): an arrival passes at or after the expiry of the last one that passed, and arms the next expiry."""
    w = F.lit(_us(cooldown)).cast("long")
    start = F.struct(F.lit(None).cast("long").alias("free"), F.expr("cast(array() as array<bigint>)").alias("ok"))

    def step(acc: Column, t: Column) -> Column:
        passed = acc["free"].isNull() | (t >= acc["free"])
        return F.struct(F.when(passed, t + w).otherwise(acc["free"]).alias("free"), F.when(passed, F.concat(acc["ok"], F.array(t))).otherwise(acc["ok"]).alias("ok"))

    folded = arrivals.groupBy(key).agg(F.array_sort(F.collect_set(_micros(F.col(ts)))).alias("_t"))
    return folded.select(key, F.explode(F.aggregate("_t", start, step, lambda acc: acc["ok"])).alias("_at")).select(key, _time(F.col("_at")).alias("accepted_at"))


def token_bucket(requests: DataFrame, key: str, ts: str, capacity: int, per_second: float, order: str) -> DataFrame:
    """(key, order, requested_at, admitted_at): each request takes one token, waiting for it if there is none; none fails.

    Whole microseconds all through: a request is admitted when the bucket, were it refilled a token at a time, owes no more than its capacity.
    """
    interval = round(1e6 / per_second)
    start = F.struct(F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("full"), F.expr("cast(array() as array<struct<o:bigint,t:bigint,a:bigint>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        # ``full``: when the bucket is full again. F.greatest ignores nulls.
        at = F.greatest(x["t"], acc["at"], acc["full"] - (int(capacity) - 1) * interval)
        return F.struct(at.alias("at"), (F.greatest(at, acc["full"]) + interval).alias("full"), F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), x["t"].alias("t"), at.alias("a")))).alias("out"))

    rows = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(_micros(F.col(ts)).alias("t"), F.col(order).cast("long").alias("o")))).alias("_x"))
    out = rows.select(key, F.explode(F.aggregate("_x", start, step, lambda acc: acc["out"])).alias("r"))
    return out.select(key, F.col("r.o").alias(order), _time(F.col("r.t")).alias("requested_at"), _time(F.col("r.a")).alias("admitted_at"))


def seed_of(*parts: Column) -> Column:
    """A number below 2**32 from columns, the same in every process: the CRC-32 of the parts joined by ``|``."""
    return F.crc32(F.concat_ws("|", *parts).cast("binary"))


def retry_delay(attempt: Column, base_us: Column, factor: Column, jitter: Column, seed: Column) -> Column:
    """Microseconds before the retry that follows failure number ``attempt`` (from 1): exponential, off by up to ``jitter`` of itself, as the seed says."""
    return (base_us * F.pow(factor, attempt - 1) * (1 + jitter * (seed / F.lit(float(1 << 31)) - 1))).cast("long")


def backoff_schedule(failures: DataFrame, policy: RetryPolicy) -> DataFrame:
    """Adds ``attempt`` and ``delay_ms``, one row for each retry of each failed row."""
    n = max(0, policy.max_attempts - 1)
    base = policy.base.total_seconds() * 1000
    return failures.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("delay_ms", F.lit(base) * F.pow(F.lit(policy.factor), F.col("attempt") - 1))


def park_points(arrivals: DataFrame, key: str, ts: str, park_after: timedelta) -> DataFrame:
    """(key, parked_at): where nothing came for ``park_after``. An arrival at that very instant still beats the park."""
    gap = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    until = F.col(ts) + F.lit(park_after)
    return arrivals.select(key, ts, gap.alias("_next")).filter(F.col("_next").isNotNull() & (F.col("_next") > until)).select(key, until.alias("parked_at"))


def within_deadline(arrivals: DataFrame, key: str, ts: str, budget: timedelta) -> DataFrame:
    """Adds ``in_time``: before the first arrival of the key plus ``budget``. Nothing is dropped."""
    first = arrivals.groupBy(key).agg(F.min(ts).alias("_first"))
    return arrivals.join(first, key).withColumn("in_time", F.col(ts) < F.col("_first") + F.lit(budget)).drop("_first")


def soonest_due(windows: DataFrame, due: str = "due_at") -> DataFrame:
    """(session_id, due_at): the next armed window of each session."""
    return windows.groupBy("session_id").agg(F.min(due).alias("due_at"))


def holding_windows(windows: DataFrame, satisfied: DataFrame) -> DataFrame:
    """The armed windows (session_id, operator_id, interim, due_at) that hold gathering open: an interim aggregator's does not once its session's completion is satisfied,
    for the final document is then due anyway. ``satisfied``: (session_id, satisfied)."""
    known = windows.join(satisfied, "session_id", "left")
    return known.filter(~(F.col("interim") & F.coalesce("satisfied", F.lit(False)))).drop("satisfied")
