"""Activation of capabilities: lazily, what is required before what requires it, with a cool-off after failures and an end to trying."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from factloom.errors import CapabilityUnavailableError
from factloom.operators.base import Capability


@dataclass
class _Try:
    failures: int = 0
    not_before: datetime | None = None
    given_up: bool = False


@dataclass
class Activator:
    """Connections of one process, by (namespace, capability). A failed one is tried again after ``cool_off``; after ``max_attempts`` it is given up, which is reported once."""

    capabilities: Sequence[Capability]
    credentials: Callable[[str, str], dict]
    max_attempts: int = 3
    cool_off: timedelta = timedelta(seconds=30)
    timeout: timedelta | None = None
    live: dict[tuple[str, str], Capability] = field(default_factory=dict)
    tries: dict[tuple[str, str], _Try] = field(default_factory=dict)

    @staticmethod
    def needed(capabilities: Sequence[Capability]) -> bool:
        """False if no capability has anything to activate."""
        return any(type(c).activate is not Capability.activate for c in capabilities)

    def _layers(self) -> list[Capability]:
        """Providers before those that require them; what waits for nobody's kind comes last and is not activated."""
        out, given, left = [], set(), list(self.capabilities)
        while left:
            free = [c for c in left if set(c.requires) <= given]
            if not free:
                break
            out += sorted(free, key=lambda c: c.capability_id)
            given |= {k for c in free for k in (*c.kinds, c.capability_id)}
            left = [c for c in left if c not in free]
        return out

    def _connect(self, c: Capability, namespace: str) -> Capability:
        made = type(c)()
        if self.timeout is None:
            made.activate(self.credentials(namespace, c.capability_id))
            return made
        pool = ThreadPoolExecutor(1)
        try:
            pool.submit(made.activate, self.credentials(namespace, c.capability_id)).result(self.timeout.total_seconds())
            return made
        except FutureTimeout:
            raise TimeoutError(f"took more than {self.timeout}") from None
        finally:
            pool.shutdown(wait=False)

    def refresh(self, now: datetime, wanted: set[tuple[str, str]]) -> list[tuple[str, str, str, str | None]]:
        """Activates what is wanted and can be now; (namespace, capability, outcome, detail) of what happened: activated, failed or given_up."""
        told = []
        for c in self._layers():
            for namespace in sorted({n for n, x in wanted if x == c.capability_id}):
                at = (namespace, c.capability_id)
                mark = self.tries.setdefault(at, _Try())
                if at in self.live or mark.given_up or (mark.not_before is not None and now < mark.not_before):
                    continue
                below = {k for (n, _), p in self.live.items() if n == namespace for k in (*p.kinds, p.capability_id)}
                if not set(c.requires) <= below:
                    continue
                try:
                    self.live[at] = self._connect(c, namespace)
                    told.append((*at, "activated", None))
                except Exception as e:  # noqa: BLE001 - a user's activation may raise anything
                    mark.failures += 1
                    mark.not_before = now + self.cool_off
                    mark.given_up = mark.failures >= self.max_attempts
                    told.append((*at, "given_up" if mark.given_up else "failed", f"{type(e).__name__}: {str(e)[:200]}"))
        return told

    def next_try(self, wanted: set[tuple[str, str]]) -> datetime | None:
        """When the first wanted connection in its cool-off may be tried again."""
        times = [t.not_before for at, t in self.tries.items() if at in wanted and at not in self.live and not t.given_up and t.not_before is not None]
        return min(times, default=None)

    def instance(self, namespace: str, capability: str) -> Capability:
        if (namespace, capability) not in self.live:
            raise CapabilityUnavailableError(f"{capability} is not active in {namespace}")
        return self.live[namespace, capability]


class TokenBucket:
    """Live rate limits of one process by key (namespace:capability): callers wait for a token, and none fails."""

    def __init__(self, capacity: float, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.capacity, self.rate, self.clock, self.sleep = capacity, per_second, clock, sleep
        self._state: dict[str, tuple[float, float]] = {}
        self._lock = threading.Lock()

    def acquire(self, key: str) -> float:
        """Takes a token and returns how long it had to wait for it."""
        with self._lock:
            now = self.clock()
            at, tokens = self._state.get(key, (now, self.capacity))
            free = min(self.capacity, tokens + max(0.0, now - at) * self.rate)
            # A debt is a place in the queue: whoever comes next waits behind it.
            wait = max(0.0, (1.0 - free) / self.rate)
            self._state[key] = (now, free - 1.0)
        if wait:
            self.sleep(wait)
        return wait
