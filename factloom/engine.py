"""Supersteps over all sessions: readiness, runs, merge, until nothing is runnable; then aggregators.

One superstep plans every (session, operator) pair with a few joins, runs each operator that has a runnable session once over all of them, several operators
at a time, and merges all emissions in one aggregation. What each step leaves is written to the shared folder, so plans do not grow and a lost executor costs one step.
The number of steps depends on the length of the operator graph and cycle bounds, not on the number of sessions.

Time: with a fixed ``now`` it is virtual, and waiting for a debounce window or a retry moves it to the instant that is due; otherwise the engine's clock says it, and the
engine sleeps. The deadline ends waiting as well as running: what is there then is aggregated.

Failures belong to sessions: where a set-wise operator fails over many sessions, it is run again over halves by the hash of the session, so that only the part with the
bad session fails. A fault in every eighth of the sessions is the operator's own and fails it everywhere; so does a timeout.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import facts as facts_ops
from factloom.errors import StepLimitError
from factloom.flow import Flow
from factloom.operators.activation import Activator
from factloom.operators.base import Context, Operator, RerunOn, RowOperator, SessionCapabilities, undeclared
from factloom.plans import completion as conditions
from factloom.plans import readiness, scheduling
from factloom.sources.archive import Archive
from factloom.sources.audit import AuditTrail, event_rows, merge_rows, run_rows
from factloom.sources.control import Catalog
from factloom.sources.durable import FINAL, INTERIM, DurableStore
from factloom.sources.workspace import local, materialize, shared_dir
from factloom.telemetry import Telemetry
from factloom.types import FACT_DDL

log = logging.getLogger("factloom")
OP_STATE_DDL = "session_id string, operator_id string, watermark bigint, runs bigint, failed_attempts int, due_at timestamp_ntz, caps array<string>"
RUN_LOG_DDL = "step int, session_id string, operator_id string, outcome string, detail string, at timestamp_ntz"
FAILURE_DDL = "session_id string, operator_id string, detail string"
PARALLEL = 4
#: Depth to which failing sets of sessions are halved while every half fails.
EIGHTHS = 3
TIMED_OUT, CANCELLED = "timed out", "cancelled by the deadline"


def _us(d: timedelta) -> int:
    return d // timedelta(microseconds=1)


def later(at: datetime, us: Column) -> Column:
    """An instant and so many microseconds."""
    return F.timestamp_micros(F.unix_micros(F.lit(at).cast("timestamp_ntz").cast("timestamp")) + us).cast("timestamp_ntz")


@dataclass
class Result:
    """What a run leaves. ``sessions``: (session_id, status, revision); ``runs``: the run log; ``stalled``: (session_id, operator_id) that could still have run."""

    facts: DataFrame
    op_state: DataFrame
    sessions: DataFrame
    runs: DataFrame
    documents: DataFrame | None = None
    steps: int = 0
    dead_letters: list[tuple[str, str]] = field(default_factory=list)
    deadline_hit: bool = False
    stalled: DataFrame | None = None
    activated: list[tuple] = field(default_factory=list)
    telemetry: Telemetry = field(default_factory=Telemetry)


class Engine:
    """``now`` stamps emissions: one instant for each superstep."""

    def __init__(self, spark: SparkSession, base: str | None = None, catalog: Catalog | None = None, archive: Archive | None = None, audit: AuditTrail | None = None, clock: Callable[[], datetime] | None = None, sleep: Callable[[float], None] = time.sleep, activator: Activator | None = None):
        self.spark, self.base = spark, base or f"{shared_dir(spark)}/factloom/engine"
        self.catalog, self.archive, self.audit = catalog, archive, audit
        self.clock, self.sleep = clock or (lambda: datetime.now().replace(tzinfo=None)), sleep
        self.activator = activator

    # -- one superstep -----------------------------------------------------------------------------------------

    def plan(self, flow: Flow, state: DataFrame, op_state: DataFrame, sessions: DataFrame, nodes: list, now: datetime, lite: bool = False) -> DataFrame:
        """Every pair that wants to run: (session_id, operator_id, watermark, runs, failed_attempts, due_at, caps, runnable, lost).

        A pair wants to run if it is ready and under its bound, and never ran, or has a retry due, or may rerun and has relevant new data or a new capability. It is
        runnable unless its window or retry is due later. ``lost``: an armed retry that is not ready any more, which the small form ends.
        """
        spark = self.spark
        have = readiness.present_ancestors(state, flow.types)
        rows = [(x.operator_id, x.policy.max_cycles, x.policy.rerun_on_new_data, _us(x.policy.debounce)) for x in nodes]
        ids = local(spark, rows, "operator_id string, max_cycles int, reruns boolean, debounce_us bigint")
        ok = readiness.ready(sessions, have, readiness.declared(spark, nodes, "depends_on"), ids.select("operator_id"))
        caps = self.capabilities(flow, state, sessions, have)
        if any(x.requires for x in nodes):
            given = caps.join(F.broadcast(self._kinds(flow)), "capability_id").select("session_id", F.col("kind").alias("wanted")).distinct()
            ok = ok.join(readiness.ready(sessions, given, readiness.declared(spark, nodes, "requires"), ids.select("operator_id")), ["session_id", "operator_id"], "left_semi")
        if self.catalog is not None and self.catalog.operators:
            grants = self.catalog.grants(spark, "operators", "operator_id")
            ok = readiness.permitted_operators(ok.join(sessions.select("session_id", "namespace_id"), "session_id"), grants).select("session_id", "operator_id")
        pairs = ok.join(op_state, ["session_id", "operator_id"], "left").join(F.broadcast(ids), "operator_id")
        if flow.capabilities:
            pairs = pairs.join(caps.groupBy("session_id").agg(F.sort_array(F.collect_set("capability_id")).alias("_caps")), "session_id", "left")
        else:
            pairs = pairs.withColumn("_caps", F.lit(None).cast("array<string>"))
        pairs = pairs.withColumns({"runs": F.coalesce("runs", F.lit(0)), "failed_attempts": F.coalesce("failed_attempts", F.lit(0)), "_caps": F.coalesce("_caps", F.expr("cast(array() as array<string>)"))})
        pairs = pairs.filter(F.col("max_cycles").isNull() | (F.col("runs") < F.col("max_cycles")))
        wanted = [(x.operator_id, w, x.policy.rerun_on is RerunOn.ADDED_ONLY) for x in nodes for w in {*x.depends_on, *x.uses} if x.policy.rerun_on_new_data]
        fresh = (F.col("runs") == 0) & (F.col("failed_attempts") == 0)
        retry = F.col("failed_attempts") > 0
        again = F.lit(False)
        if any(x.policy.rerun_on_new_data for x in nodes):
            # A session that never had a capability view of this operator has seen what its last run saw: nothing.
            grown = F.size(F.array_except("_caps", F.coalesce("caps", F.expr("cast(array() as array<string>)")))) > 0
            delta = pairs.filter("runs > 0 and reruns and failed_attempts = 0").select("session_id", "operator_id", "watermark").join(state.select("session_id", "type", "added_rev", "updated_rev"), "session_id")
            delta = delta.withColumn("change", F.when(F.col("added_rev") > F.col("watermark"), "added").when(F.col("updated_rev") > F.col("watermark"), "updated")).filter("change is not null")
            hit = readiness.relevant_new_data(delta.select("session_id", "operator_id", "type", "change"), flow.types, local(spark, wanted, "operator_id string, wanted string, added_only boolean"))
            pairs = pairs.join(hit.withColumn("_hit", F.lit(True)), ["session_id", "operator_id"], "left")
            again = (F.col("runs") > 0) & (F.col("failed_attempts") == 0) & F.col("reruns") & (F.coalesce("_hit", F.lit(False)) | grown)
        pairs = pairs.filter(fresh | retry | again)
        # A window is armed once and does not slide; a retry's instant was set when its run failed.
        due = F.coalesce("due_at", F.when(F.col("debounce_us") > 0, later(now, F.col("debounce_us"))))
        out = pairs.select("session_id", "operator_id", "watermark", "runs", "failed_attempts", due.alias("due_at"), F.col("_caps").alias("caps"))
        out = out.withColumns({"runnable": F.col("due_at").isNull() | (F.col("due_at") <= F.lit(now).cast("timestamp_ntz")), "lost": F.lit(False)})
        if lite:
            lost = op_state.filter("failed_attempts > 0").join(ok, ["session_id", "operator_id"], "left_anti")
            out = out.unionByName(lost.select("session_id", "operator_id", "watermark", "runs", "failed_attempts", "due_at", "caps", F.lit(False).alias("runnable"), F.lit(True).alias("lost")))
        return out

    def _kinds(self, flow: Flow) -> DataFrame:
        return local(self.spark, [(c.capability_id, k) for c in flow.capabilities for k in sorted({*c.kinds, c.capability_id})], "capability_id string, kind string")

    def capabilities(self, flow: Flow, state: DataFrame, sessions: DataFrame, have: DataFrame | None = None, active_only: bool = True) -> DataFrame:
        """(session_id, capability_id) that are available now: permitted, fed, provided for, and active if there is anything to activate."""
        if not flow.capabilities:
            return local(self.spark, [], "session_id string, capability_id string")
        permitted = None
        if self.catalog is not None and self.catalog.capabilities:
            every = sessions.select("session_id", "namespace_id").withColumn("capability_id", F.explode(F.array(*[F.lit(c.capability_id) for c in flow.capabilities])))
            grants = self.catalog.grants(self.spark, "capabilities", "operator_id")
            permitted = readiness.permitted_operators(every.withColumnRenamed("capability_id", "operator_id"), grants).select("session_id", F.col("operator_id").alias("capability_id"))
        have = readiness.present_ancestors(state, flow.types) if have is None else have
        out = readiness.available_capabilities(sessions, have, self.spark, flow.capabilities, permitted)
        if active_only and self.activator is not None and Activator.needed(flow.capabilities):
            passive = [c.capability_id for c in flow.capabilities if type(c).activate.__qualname__ == "Capability.activate"]
            live = local(self.spark, sorted(self.activator.live, key=repr), "namespace_id string, capability_id string")
            named = out.join(sessions.select("session_id", "namespace_id"), "session_id")
            out = named.filter(F.col("capability_id").isin(passive)).select("session_id", "capability_id").unionByName(named.join(F.broadcast(live), ["namespace_id", "capability_id"], "left_semi").select("session_id", "capability_id"))
        return out

    def offers(self, flow: Flow, state: DataFrame, sessions: DataFrame) -> DataFrame:
        """(session_id, kind, capability_id, rank) of available providers, by the namespaces' preferences, then by id."""
        if self.catalog is not None and self.catalog.preferred:
            preferred = sessions.select("session_id", "namespace_id").join(F.broadcast(self.catalog.preferences(self.spark)), "namespace_id").drop("namespace_id")
        else:
            preferred = local(self.spark, [], "session_id string, capability_id string, position int")
        return readiness.resolve_providers(self.capabilities(flow, state, sessions), self._kinds(flow), preferred)

    def _activate(self, flow: Flow, state: DataFrame, sessions: DataFrame, now: datetime, result: Result) -> set[tuple[str, str]]:
        """Tries what is available but not active; the wanted (namespace, capability) pairs are as few as namespaces times declarations."""
        if self.activator is None or not Activator.needed(flow.capabilities):
            return set()
        could = self.capabilities(flow, state, sessions, active_only=False).join(sessions.select("session_id", "namespace_id"), "session_id")
        wanted = {(r["namespace_id"], r["capability_id"]) for r in could.select("namespace_id", "capability_id").distinct().collect()}
        result.activated += [(now, *told) for told in self.activator.refresh(now, wanted)]
        return wanted

    def context(self, flow: Flow, state: DataFrame, mine: DataFrame, sessions: DataFrame) -> Context:
        marks = mine.select("session_id", "watermark")
        store = state.join(marks.select("session_id"), "session_id", "left_semi")
        asked = marks.select("session_id")
        offers = lambda: self.offers(flow, store, sessions.join(asked, "session_id", "left_semi"))
        return Context(self.spark, flow.types, store, facts_ops.operator_delta(store, marks), asked, SessionCapabilities(offers, asked))

    def _try(self, operator: Operator, ctx: Context, limit: timedelta) -> tuple[DataFrame | None, str | None]:
        """(emissions, error): the operator's rows in their order, computed and written within its timeout."""
        tag = f"factloom-{operator.operator_id}"

        def work() -> DataFrame:
            self.spark.addTag(tag)
            try:
                out = operator.transform(ctx).select("session_id", "type", "value")
                return materialize(out.withColumn("_at", F.monotonically_increasing_id()), f"emit-{operator.operator_id}")
            finally:
                self.spark.removeTag(tag)

        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(work).result(timeout=max(0.001, limit.total_seconds())), None
        except FutureTimeout:
            self.spark.interruptTag(tag)
            return None, TIMED_OUT
        except Exception as e:  # noqa: BLE001 - a user's transform may raise anything; the run log says what
            log.warning("operator %s failed: %s", operator.operator_id, e)
            return None, f"{type(e).__name__}: {str(e)[:300]}"
        finally:
            pool.shutdown(wait=False)

    def attempt(self, flow: Flow, state: DataFrame, sessions: DataFrame, op: Operator, mine: DataFrame, n: int, limit: timedelta) -> tuple[list[DataFrame], DataFrame | None]:
        """(emissions, failures): a failing set of sessions is halved until the bad ones stand alone."""
        rows, error = self._try(op, self.context(flow, state, mine, sessions), limit)
        if error is None:
            return [rows], None
        told = lambda part, e: part.select("session_id", F.lit(op.operator_id).alias("operator_id"), F.lit(e).alias("detail"))
        if n <= 1 or error == TIMED_OUT:
            return [], told(mine, error)
        good: list[DataFrame] = []
        bad: list[tuple[DataFrame, str]] = []
        open_ = [(0, 0)]  # sessions whose hash is r modulo 2 ** k
        place = F.xxhash64("session_id", F.lit(7))
        while open_:
            below, clean = [], 0
            for k, r in open_:
                for half in (r, r + (1 << k)):
                    part = mine.filter(F.pmod(place, F.lit(1 << (k + 1))) == half)
                    size = part.count()
                    if not size:
                        continue
                    rows, error = self._try(op, self.context(flow, state, part, sessions), limit)
                    if error is None:
                        good.append(rows)
                        clean += 1
                    elif size > 1 and error != TIMED_OUT:
                        below.append((k + 1, half, part, error))
                    else:
                        bad.append((part, error))
            if below and not good and below[0][0] >= EIGHTHS and not clean:
                bad += [(part, error) for *_, part, error in below]
                break
            open_ = [(k, r) for k, r, *_ in below]
        out = None
        for part, e in bad:
            out = told(part, e) if out is None else out.unionByName(told(part, e))
        return good, out

    # -- a whole run -------------------------------------------------------------------------------------------

    def run(self, flow: Flow, seed: DataFrame, state: DataFrame | None = None, op_state: DataFrame | None = None, now: datetime | None = None, epoch: int = 1, deadline_hit: bool = False, max_steps: int = 1000, started: datetime | None = None, lite: bool = False) -> Result:
        """Runs every session of ``seed`` (FACT_DDL columns; stamps are set here) and ``state`` until nothing is runnable.

        ``started``: when the flow's deadline began to run, if not now. ``lite``: the deadline is hard (a run is cut short by it), and a retry that is not ready any more ends.
        More than ``max_steps`` supersteps raise :class:`StepLimitError`.
        """
        spark, tele = self.spark, Telemetry()
        state = local(spark, [], FACT_DDL) if state is None else state
        op_state = local(spark, [], OP_STATE_DDL) if op_state is None else op_state
        for name, kind in (("due_at", "timestamp_ntz"), ("caps", "array<string>")):
            op_state = op_state if name in op_state.columns else op_state.withColumn(name, F.lit(None).cast(kind))
        flow.types.check_known(seed)
        t, virtual, began = now or self.clock(), now is not None, time.monotonic()
        deadline = (started or t) + flow.deadline
        audit: list[DataFrame] = []
        result = Result(state, op_state, state, state, telemetry=tele)
        state = self._merge(flow, state, seed, epoch, tele, audit)
        # Sessions without a fact still run operators that depend on nothing; such sessions come from the seed's null-typed rows only.
        sessions = materialize(state.groupBy("session_id").agg(F.max("namespace_id").alias("namespace_id")), "sessions")
        logs: list[DataFrame] = []
        reported: set[tuple[str, str]] = set()
        step = 0
        while flow.pruned and not deadline_hit:
            t = t if virtual else self.clock()
            if t >= deadline:
                deadline_hit = True
                break
            wanted = self._activate(flow, state, sessions, t, result)
            todo = materialize(self.plan(flow, state, op_state, sessions, flow.pruned, t, lite), "plan")
            found = todo.groupBy("operator_id", "runnable", "lost").agg(F.count(F.lit(1)).alias("n"), F.min("due_at").alias("due")).collect()  # a few for each operator
            active = {r["operator_id"]: r["n"] for r in found if r["runnable"]}
            if not active:
                dues = [r["due"] for r in found if not r["lost"]]
                retry_caps = self.activator.next_try(wanted) if wanted else None
                dues += [retry_caps] if retry_caps is not None else []
                if any(r["lost"] for r in found) or any(not r["lost"] for r in found):
                    op_state = self._arm(op_state, todo)
                if not dues:
                    break
                t = self._wait(t, min(dues), deadline, virtual)
                continue
            step += 1
            if step > max_steps:
                raise StepLimitError(f"more than {max_steps} supersteps; still runnable: {sorted(active)}")
            revision = facts_ops.revisions(state)
            chosen = [(no, op) for no, op in enumerate(flow.pruned) if op.operator_id in active]

            def launch(item, state=state, todo=todo, active=active):
                no, op = item
                limit = op.policy.timeout or flow.timeout
                if lite:
                    limit = min(limit, flow.deadline - timedelta(seconds=time.monotonic() - began))
                mine = todo.filter((F.col("operator_id") == op.operator_id) & F.col("runnable"))
                with tele.timed("operator", op.operator_id):
                    return no, op, *self.attempt(flow, state, sessions, op, mine, active[op.operator_id], limit)

            with ThreadPoolExecutor(PARALLEL) as pool:
                done = list(pool.map(launch, chosen))
            if lite and time.monotonic() - began >= flow.deadline.total_seconds():
                deadline_hit = True
            batch, failures = self._stamp(flow, done, t, step, reported, sessions)
            state = self._merge(flow, state, batch, epoch, tele, audit)
            advanced = self._advance(todo, revision, failures, flow, t, deadline_hit and lite)
            # One table holds the new state and, of the pairs that ran, the outcome, which is the step's part of the run log.
            kept = materialize(op_state.join(todo, ["session_id", "operator_id"], "left_anti").unionByName(advanced, allowMissingColumns=True), "op-state")
            op_state = kept.drop("outcome", "detail")
            logs.append(kept.filter("outcome is not null").select(F.lit(step).alias("step"), "session_id", "operator_id", "outcome", "detail", F.lit(t).cast("timestamp_ntz").alias("at")))
            tele.count_runs(logs[-1])
            audit += [run_rows(logs[-1])] if self.audit is not None else []
        runs = local(spark, [], RUN_LOG_DDL)
        for part in logs:
            runs = runs.unionByName(part)
        done = conditions.satisfied(state, sessions, flow.completes_when, flow.types) if flow.completes_when is not None else sessions.select("session_id", F.lit(True).alias("satisfied"))
        status = F.when(F.col("satisfied"), "COMPLETED").otherwise(F.lit("COMPLETED" if deadline_hit else "PARKED" if flow.park_after is not None else "WAITING"))
        table = done.withColumn("status", status).join(facts_ops.revisions(state), "session_id", "left")
        table = materialize(table.select("session_id", "status", F.coalesce("revision", F.lit(0)).alias("revision"), "satisfied"), "result")
        result.facts, result.op_state, result.runs, result.steps, result.deadline_hit = state, op_state, runs, step, deadline_hit
        result.sessions = table.drop("satisfied")
        if flow.pruned and (deadline_hit or flow.completes_when is not None):
            result.stalled = self._stalled(flow, state, op_state, sessions, table.filter(F.lit(deadline_hit) | ~F.col("satisfied")))
        if flow.aggregators:
            audit += self.aggregate(flow, result, sessions, table, epoch, t)
        if self.audit is not None:
            named = lambda rows: rows.withColumn("at", F.lit(t).cast("timestamp_ntz"))
            audit.append(named(event_rows(result.sessions.filter("status = 'PARKED'"), "session_parked")))
            if result.activated:
                told = local(spark, [(n, c, o, d, at) for at, n, c, o, d in result.activated], "namespace_id string, subject string, outcome string, detail string, at timestamp_ntz")
                audit.append(sessions.select("session_id", "namespace_id").join(F.broadcast(told), "namespace_id").select("session_id", F.lit("capability").alias("kind"), "subject", "outcome", "detail", F.lit(1).cast("bigint").alias("n"), "at"))
            rows = audit[0].drop("epoch").withColumn("_part", F.lit(0))
            for no, part in enumerate(audit[1:], 1):
                rows = rows.unionByName(part.drop("epoch").withColumn("_part", F.lit(no)))
            self.audit.append(rows.withColumn("epoch", F.lit(epoch).cast("bigint")), epoch)
        return result

    def _wait(self, t: datetime, due: datetime, deadline: datetime, virtual: bool) -> datetime:
        """The instant that is due, or the deadline if it comes first."""
        until = min(due, deadline)
        if not virtual:
            self.sleep(max(0.0, (until - self.clock()).total_seconds()))
        return max(until, t)

    def _arm(self, op_state: DataFrame, todo: DataFrame) -> DataFrame:
        """Windows that wait are kept with their instants; lost retries end."""
        gone = F.col("lost")
        new = todo.select("session_id", "operator_id", "watermark", "runs", F.when(gone, 0).otherwise(F.col("failed_attempts")).cast("int").alias("failed_attempts"), F.when(~gone, F.col("due_at")).alias("due_at"), "caps")
        # What a waiting pair has seen of capabilities is what its last run saw.
        new = new.drop("caps").join(op_state.select("session_id", "operator_id", "caps"), ["session_id", "operator_id"], "left")
        return materialize(op_state.join(todo, ["session_id", "operator_id"], "left_anti").unionByName(new), "op-state")

    def _stalled(self, flow: Flow, state: DataFrame, op_state: DataFrame, sessions: DataFrame, open_sessions: DataFrame) -> DataFrame:
        """Operators of open sessions that never ran though declarations say that they could be reached; a warning tells their number."""
        ids = local(self.spark, [(x.operator_id,) for x in flow.pruned], "operator_id string").agg(F.collect_set("operator_id").alias("_ids"))
        mine = sessions.join(open_sessions, "session_id", "left_semi")
        every = mine.withColumn("_k", F.lit(1)).join(F.broadcast(ids.withColumn("_k", F.lit(1))), "_k").select("session_id", F.explode("_ids").alias("operator_id"))
        pending = every.join(op_state.filter("runs > 0"), ["session_id", "operator_id"], "left_anti")
        provided = None
        if any(x.requires for x in flow.pruned):
            provided = self.capabilities(flow, state, mine).join(F.broadcast(self._kinds(flow)), "capability_id").select("session_id", F.col("kind").alias("wanted")).distinct()
        have = readiness.present_ancestors(state.join(mine, "session_id", "left_semi"), flow.types)
        out = materialize(readiness.reachable_pending(have, mine, pending, flow.pruned, flow.types, provided), "stalled")
        counts = {r["operator_id"]: r["count"] for r in out.groupBy("operator_id").count().collect()}
        if counts:
            log.warning("flow %s ends with pending operators that could be reached: %s", flow.name, counts)
        return out

    def _merge(self, flow: Flow, state: DataFrame, batch: DataFrame, epoch: int, tele: Telemetry, audit: list) -> DataFrame:
        keyed = batch.withColumn("value_key", flow.types.value_keys()).select(*[c for c in state.columns if c not in ("added_rev", "updated_rev")])
        merged = tele.observed(facts_ops.apply_batch(state, keyed, facts_ops.revisions(state)))
        out = materialize(merged, "facts")
        if self.audit is not None:
            audit.append(merge_rows(facts_ops.outcomes(keyed, state), flow.types, epoch, self.archive.ciphers if self.archive else None))
        if self.archive is not None:
            self.archive.archive(keyed, epoch)
        return out

    def _stamp(self, flow: Flow, done: list, now: datetime, step: int, reported: set, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(facts, failures) of all emissions, by operator and then in their own order; provenance and time are the engine's to say.

        Rows of unregistered or abstract types are no facts: the sessions that emitted them failed, what else they emitted stays.
        """
        columns = "session_id string, type string, value string, retrieved_by string, ins_seq bigint"
        out, failures = local(self.spark, [], columns), local(self.spark, [], FAILURE_DDL)
        known = [x for x in flow.types.names() if not flow.types[x].abstract]
        for no, op, parts, failed in done:
            failures = failures if failed is None else failures.unionByName(failed)
            for part_no, rows in enumerate(parts):
                seen = {r["type"] for r in rows.select("type").distinct().collect()}  # names of types
                error = F.when(F.col("type") == RowOperator.ERROR, F.col("value")).otherwise(F.concat(F.lit("InvalidTypeError: "), F.coalesce("type", F.lit("null")), F.lit(" cannot be emitted")))
                if seen - set(known):
                    bad = rows.filter(F.col("type").isNull() | ~F.col("type").isin(known))
                    failures = failures.unionByName(bad.groupBy("session_id").agg(F.min_by(error, "_at").alias("detail")).select("session_id", F.lit(op.operator_id).alias("operator_id"), "detail"))
                    rows = rows.filter(F.col("type").isin(known))
                for kind in undeclared(seen & set(known), op, flow.types):
                    if (op.operator_id, kind) not in reported:
                        reported.add((op.operator_id, kind))
                        log.error("operator %s emitted %s, which it does not declare", op.operator_id, kind)
                # Arrival order: step, operator, then the place among the session's rows, which the written emission fixes.
                place = F.row_number().over(Window.partitionBy("session_id").orderBy("_at"))
                seq = F.lit((step * 1000 + no + 1) * 2**40 + part_no * 2**32).cast("bigint") + place
                out = out.unionByName(rows.select("session_id", "type", "value", F.lit(op.operator_id).alias("retrieved_by"), seq.alias("ins_seq")))
        stamp = F.lit(now).cast("timestamp_ntz")
        facts = out.join(sessions.select("session_id", "namespace_id"), "session_id", "left").withColumns({"first_retrieved": stamp, "last_retrieved": stamp})
        return facts, failures

    def _advance(self, todo: DataFrame, revision: DataFrame, failures: DataFrame, flow: Flow, now: datetime, cut: bool) -> DataFrame:
        """The new operator state of all planned pairs, with the outcome of those that ran.

        Watermarks move to the revision seen at launch, unless a retry is due; a terminal failure moves them too. A run that the hard deadline cut short did not happen.
        """
        rows = [(x.operator_id, x.policy.retry.max_attempts, _us(x.policy.retry.base), float(x.policy.retry.factor), float(x.policy.retry.jitter), x.policy.max_cycles) for x in flow.pruned]
        policies = local(self.spark, rows, "operator_id string, attempts int, base_us bigint, factor double, jitter double, max_cycles int")
        first = failures.groupBy("session_id", "operator_id").agg(F.min("detail").alias("detail"))
        ran = todo.join(F.broadcast(policies), "operator_id").join(revision, "session_id", "left").join(first, ["session_id", "operator_id"], "left")
        go, broke = F.col("runnable"), F.col("detail").isNotNull()
        cancelled = broke & (F.col("detail") == TIMED_OUT) & F.lit(cut)
        tries = F.col("failed_attempts") + 1
        again = go & broke & ~cancelled & (tries < F.col("attempts")) & (F.col("max_cycles").isNull() | (F.col("runs") + 1 < F.col("max_cycles")))
        delay = scheduling.retry_delay(tries, F.col("base_us"), F.col("factor"), F.col("jitter"), scheduling.seed_of(F.col("session_id"), F.col("operator_id"), tries.cast("string")))
        outcome = F.when(~go, F.lit(None)).when(cancelled, "cancelled").when(again, "retrying").when(F.col("detail") == TIMED_OUT, "timed_out").when(broke, "failed").otherwise("succeeded")
        return ran.select(
            "session_id", "operator_id",
            F.when(~go | again | cancelled, F.col("watermark")).otherwise(F.coalesce("revision", F.lit(0))).cast("bigint").alias("watermark"),
            (F.col("runs") + F.when(go & ~cancelled, 1).otherwise(0)).cast("bigint").alias("runs"),
            F.when(again, tries).when(go | F.col("lost"), 0).otherwise(F.col("failed_attempts")).cast("int").alias("failed_attempts"),
            F.when(again, later(now, delay)).when(~go & ~F.col("lost"), F.col("due_at")).alias("due_at"),
            F.when(go, F.col("caps")).alias("caps"), outcome.alias("outcome"), F.when(cancelled, CANCELLED).otherwise(F.col("detail")).alias("detail"),
        )

    def aggregate(self, flow: Flow, result: Result, sessions: DataFrame, table: DataFrame, epoch: int, now: datetime) -> list[DataFrame]:
        """Ready aggregators that have not contributed write their documents; a failing one is retried on its backoff, then dead-lettered.

        Of a session that is not done an interim aggregator's document is written when its window is due, if that is before the deadline; a session that is done gets its final
        document at once, whatever windows are armed. Returns the audit rows of what never was ready.
        """
        spark, store = self.spark, DurableStore(self.spark, f"{self.base}/durable")
        have = readiness.present_ancestors(result.facts, flow.types)
        ids = local(spark, [(x.operator_id,) for x in flow.aggregators], "operator_id string")
        finished = result.sessions.filter("status = 'COMPLETED'").select("session_id")
        ready = readiness.ready(sessions, have, readiness.declared(spark, flow.aggregators, "depends_on"), ids)
        ready = materialize(ready.join(finished.withColumn("done", F.lit(True)), "session_id", "left").fillna(False, ["done"]), "aggregate")
        told = []
        for a in flow.aggregators:
            windows = ready.filter(F.col("operator_id") == a.operator_id).withColumns({"interim": ~F.col("done"), "due_at": later(now, F.when(F.col("done"), 0).otherwise(_us(a.policy.debounce)))})
            # What still holds a session open is waited for; its document carries the instant of its window.
            mine = windows if a.interim_refresh else windows.filter("done")
            mine = materialize(store.unmarked(mine), "aggregate").withColumn("watermark", F.lit(None).cast("bigint"))
            told.append(event_rows(finished.join(ready.filter(F.col("operator_id") == a.operator_id), "session_id", "left_anti").withColumn("subject", F.lit(a.operator_id)), "aggregation", "skipped").withColumn("at", F.lit(now).cast("timestamp_ntz")))
            if mine.isEmpty():
                continue
            for attempt in range(a.policy.retry.max_attempts):
                docs, error = self._documents(a, self.context(flow, result.facts, mine, sessions), a.policy.timeout or flow.timeout)
                if error is None:
                    batch = docs.join(mine.select("session_id", "done", "due_at"), "session_id").select(F.col("table").alias("table_name"), "key", "document", F.when(F.col("done"), FINAL).otherwise(INTERIM).alias("status"), F.col("due_at").alias("updated_at"))
                    store.upsert(batch, epoch)
                    store.mark_contributions(mine.filter("done"), epoch)
                    break
                if attempt + 1 == a.policy.retry.max_attempts:
                    result.dead_letters.append((a.operator_id, error))
                else:
                    self.sleep(a.policy.retry.base.total_seconds() * a.policy.retry.factor**attempt)
        result.documents = store.documents.read()
        return told

    def _documents(self, a, ctx: Context, limit: timedelta) -> tuple[DataFrame | None, str | None]:
        """(documents, error) of one attempt within its timeout."""
        tag = f"factloom-{a.operator_id}"

        def work() -> DataFrame:
            self.spark.addTag(tag)
            try:
                return materialize(a.aggregate(ctx).select("session_id", "table", "key", "document"), "documents")
            finally:
                self.spark.removeTag(tag)

        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(work).result(limit.total_seconds()), None
        except FutureTimeout:
            self.spark.interruptTag(tag)
            return None, f"OperationTimeoutError: took more than {limit}"
        except Exception as e:  # noqa: BLE001 - as in _try()
            return None, f"{type(e).__name__}: {str(e)[:300]}"
        finally:
            pool.shutdown(wait=False)
