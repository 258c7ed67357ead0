"""The supervisor: starts, resumes, feeds and reopens sessions under leases and epochs."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.engine import OP_STATE_DDL, Engine, Result
from factloom.errors import GateBlockedError, LockHeldError, SessionCompleteError
from factloom.flow import Flow
from factloom.sources.audit import event_rows
from factloom.sources.control import Locks
from factloom.sources.durable import DurableStore
from factloom.sources.inbox import Inbox
from factloom.sources.tables import VersionedTable
from factloom.sources.workspace import Files
from factloom.types import FACT_DDL

RECHECK = 35.0
log = logging.getLogger("factloom")


class Manager:
    """A group of sessions that are run together has one lease, one store and one inbox; ``group`` names it.

    Every write carries the lease's epoch, so an owner that lost its lease cannot write any more.
    """

    def __init__(self, spark: SparkSession, base: str, flow: Flow, engine: Engine | None = None, ttl: float = 60.0, clock: Callable[[], float] = time.time, gate_cooldown: float = 0.0, recheck: float = RECHECK):
        self.spark, self.base, self.flow, self.clock = spark, base, flow, clock
        self.engine = engine or Engine(spark, base)
        self.locks = Locks(spark, base, ttl, clock)
        self.gate_cooldown, self.recheck = gate_cooldown, recheck
        self.gate = Files(spark, f"{base}/gate")
        self.rechecks: dict[str, float] = {}
        self._busy: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    def _stores(self, group: str) -> tuple[VersionedTable, VersionedTable, Inbox]:
        base = f"{self.base}/{group}"
        return VersionedTable(self.spark, f"{base}/facts", FACT_DDL), VersionedTable(self.spark, f"{base}/op_state", OP_STATE_DDL), Inbox(self.spark, base)

    def _pass_gate(self) -> None:
        """One start for each cooldown, whichever process it is: the next number is a file that only one of them creates."""
        names = self.gate.names()
        if names and self.clock() < float(self.gate.read(names[-1]) or 0.0):
            raise GateBlockedError("the gate has not cooled down")
        if not self.gate.create(f"{int(names[-1]) + 1 if names else 0:012d}", repr(self.clock() + self.gate_cooldown)):
            raise GateBlockedError("somebody else passed the gate")
        for name in names[:-1]:
            self.gate.delete(name)

    def start(self, group: str, seed: DataFrame, now=None) -> Result:
        self._pass_gate()
        if self.locks.is_complete(group):
            raise SessionCompleteError(f"{group} is complete")
        return self._own(group, seed, now)

    def resume(self, group: str, now=None) -> Result | None:
        """Takes an orphaned group over; stands down for one that is complete, held or never began."""
        if not self.locks.is_orphaned(group):
            return None
        try:
            return self._own(group, None, now)
        except LockHeldError:
            return None

    def deliver(self, group: str, rows: DataFrame, reopen_if_complete: bool = False, now=None) -> Result | None:
        """Appends (session_id, payload, seq) durably. A held group's owner will see it; a free one is resumed; a complete one only reopens if asked."""
        self._stores(group)[2].append(rows)
        self.rechecks.pop(group, None)
        if self.locks.is_complete(group):
            return self.reopen(group, now) if reopen_if_complete else None
        if self.locks.is_held(group):
            self.rechecks[group] = self.clock() + self.recheck
            return None
        return self.resume(group, now)

    def reopen(self, group: str, now=None) -> Result:
        """Clears completion and contributions and runs again under a higher epoch."""
        epoch = self.locks.acquire(group)
        self.locks.clear_complete(group, epoch)
        self.locks.note(group, epoch, started=None)
        facts = self._stores(group)[0]
        DurableStore(self.spark, f"{self.engine.base}/durable").clear_contributions(facts.read().select("session_id").distinct(), epoch)
        self.locks.release(group, epoch)
        return self._own(group, None, now)

    def poll(self, now=None) -> list[str]:
        """Looks again at groups that were held when something was delivered to them, once ``recheck`` seconds have passed; the groups that were resumed."""
        due = [g for g, at in self.rechecks.items() if at <= self.clock()]
        out = []
        for group in due:
            del self.rechecks[group]
            if self._stores(group)[2].fresh_count() and self.resume(group, now) is not None:
                out.append(group)
        return out

    def _own(self, group: str, seed: DataFrame | None, now) -> Result:
        with self._guard:
            mine = self._busy.setdefault(group, threading.Lock())
        # Of many takers in this process one tries; the others stand down before anything is read.
        if not mine.acquire(blocking=False):
            raise LockHeldError(f"{group} is being taken over in this process")
        try:
            return self._run(group, seed, now)
        finally:
            mine.release()

    def _run(self, group: str, seed: DataFrame | None, now) -> Result:
        epoch = self.locks.acquire(group)
        facts, op_state, inbox = self._stores(group)
        try:
            self._check_drift(group, epoch, facts, now)
            started = self.locks.noted(group, "started")
            if started is None:
                started = (now or self.engine.clock()).isoformat()
                self.locks.note(group, epoch, started=started)
            with self.locks.kept(group, epoch):
                while True:
                    arrived = inbox.drain(self.flow.types, epoch)
                    ids = arrived.select("entry_id")
                    batch = arrived.drop("entry_id", "value_key")
                    if seed is not None:
                        batch = seed.unionByName(batch, allowMissingColumns=True)
                        seed = None
                    result = self.engine.run(self.flow, batch, facts.read(), op_state.read(), now, epoch, started=datetime.fromisoformat(started))
                    # Outputs are durable before entries are acknowledged, and those before completion.
                    facts.commit(result.facts, epoch)
                    op_state.commit(result.op_state.select(*[c.split()[0] for c in OP_STATE_DDL.split(", ")]), epoch)
                    inbox.ack(ids, epoch)
                    if self.engine.archive is not None:
                        self.engine.archive.flush(epoch)
                    # Entries that cannot be applied yet wait for the next owner; new ones are this one's.
                    if not inbox.fresh_count():
                        break
            if result.sessions.filter("status <> 'COMPLETED'").isEmpty():
                self.locks.mark_complete(group, epoch)
            return result
        finally:
            self.locks.release(group, epoch)

    def _check_drift(self, group: str, epoch: int, facts: VersionedTable, now) -> None:
        """A group that began under another flow goes on under this one, but not silently."""
        before = self.locks.noted(group, "flow")
        if self.flow.drifted(before):
            log.warning("group %s began under another definition of flow %s", group, self.flow.name)
            if self.engine.audit is not None:
                rows = facts.read().select("session_id").distinct().withColumns({"subject": F.lit(self.flow.name), "detail": F.lit(before)})
                self.engine.audit.append(event_rows(rows, "flow_drift").withColumns({"at": F.lit(now or self.engine.clock()).cast("timestamp_ntz"), "epoch": F.lit(epoch).cast("bigint")}), epoch)
        if before != self.flow.fingerprint():
            self.locks.note(group, epoch, flow=self.flow.fingerprint())
