"""What users declare: operators, aggregators and capabilities, with their policies and contexts."""

from __future__ import annotations

import copy
import functools
import inspect
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import timedelta
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import facts as facts_ops
from factloom.errors import CapabilityUnavailableError, MissingPolicyError, UnauditedActionError
from factloom.types import TypeRegistry

REDACTED = "<redacted>"
EMISSION_DDL = "session_id string, type string, value string"


class RerunOn(Enum):
    """Which changes make an operator run again."""

    ADDED_ONLY = "added_only"
    ANY_CHANGE = "any_change"


@dataclass(frozen=True)
class RetryPolicy:
    """Delays ``base * factor ** i``, each off by up to ``jitter`` of itself."""

    max_attempts: int = 5
    base: timedelta = timedelta(milliseconds=50)
    factor: float = 2.0
    jitter: float = 0.2


NO_RETRY = RetryPolicy(max_attempts=1)


@dataclass(frozen=True)
class OperatorPolicy:
    """``rerun_on_new_data`` has no default: it must be thought about."""

    rerun_on_new_data: bool
    rerun_on: RerunOn = RerunOn.ANY_CHANGE
    debounce: timedelta = timedelta(0)
    max_cycles: int | None = None
    timeout: timedelta | None = None
    retry: RetryPolicy = NO_RETRY


@dataclass
class Context:
    """What an operator sees of its runnable sessions: the store as launched, and what changed since its last run."""

    spark: SparkSession
    types: TypeRegistry
    store: DataFrame
    delta: DataFrame  # with ``change`` and ``is_first_invocation``
    sessions: DataFrame
    capabilities: SessionCapabilities

    @property
    def added(self) -> DataFrame:
        return self.delta.filter("change = 'added'")

    @property
    def updated(self) -> DataFrame:
        return self.delta.filter("change = 'updated'")

    def of_type(self, name: str) -> DataFrame:
        return facts_ops.of_type(self.store, self.types, name)

    def latest(self, name: str) -> DataFrame:
        """The newest fact of the type (or below it) in each session."""
        return facts_ops.latest(self.of_type(name))


def _bare(cls: type) -> bool:
    """True for a class without a body. Executors build a shipped class empty and fill it afterwards; a flow checks such classes again."""
    return all(name.startswith("_") for name in cls.__dict__)


def check_policy(x: Any) -> None:
    if not isinstance(getattr(x, "policy", None), OperatorPolicy):
        raise MissingPolicyError(f"{type(x).__name__} has no policy")


class _Declared:
    depends_on: tuple[str, ...] = ()
    uses: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()


class Operator(_Declared):
    """``transform`` gives (session_id, type, value) for all runnable sessions at once; values are JSON.

    The engine stamps provenance and time. A failed transform emits nothing; where emissions before a failure must stay, use
    :class:`RowOperator`.
    """

    operator_id: str
    policy: OperatorPolicy
    produces: tuple[str, ...] = ()
    consumes: tuple[str, ...] = ()

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        if cls.__dict__.get("abstract_operator") or _bare(cls):
            return
        if not isinstance(getattr(cls, "policy", None), OperatorPolicy):
            raise MissingPolicyError(f"{cls.__name__} has no policy")
        if not getattr(cls, "operator_id", None):
            cls.operator_id = cls.__name__

    def transform(self, ctx: Context) -> DataFrame:
        raise NotImplementedError


class RowOperator(Operator):
    """Row-wise form: ``run`` is a generator of (type, JSON value) for one session's facts.

    What it yields before it raises or before ``policy.timeout`` is up is kept; the error becomes a row of its own (``__error__``). One session's
    facts go to one task.
    """

    abstract_operator = True
    ERROR = "__error__"

    def run(self, session_id: str, facts: list[dict]) -> Iterator[tuple[str, str]]:
        raise NotImplementedError

    def transform(self, ctx: Context) -> DataFrame:
        run, limit, error = self.run, self.policy.timeout, self.ERROR

        def each(pdf):
            import time

            import pandas as pd

            session, rows, began = pdf["session_id"].iloc[0], [], time.monotonic()
            try:
                for kind, value in run(session, pdf.sort_values("ins_seq").to_dict("records")):
                    rows.append((session, kind, value))
                    if limit is not None and time.monotonic() - began > limit.total_seconds():
                        raise TimeoutError(f"took more than {limit}")
            except Exception as e:  # noqa: BLE001 - a user's generator may raise anything, and what it gave so far stays
                rows.append((session, error, f"{type(e).__name__}: {e}"))
            return pd.DataFrame(rows, columns=["session_id", "type", "value"])

        return ctx.store.groupBy("session_id").applyInPandas(each, EMISSION_DDL)


class Aggregator(_Declared):
    """``aggregate`` gives (session_id, table, key, document) for all ready sessions; documents are JSON."""

    operator_id: str
    policy: OperatorPolicy
    consumes: tuple[str, ...] = ()
    interim_refresh: bool = False

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        if _bare(cls):
            return
        if not isinstance(getattr(cls, "policy", None), OperatorPolicy):
            raise MissingPolicyError(f"{cls.__name__} has no policy")
        if not getattr(cls, "operator_id", None):
            cls.operator_id = cls.__name__

    def aggregate(self, ctx: Context) -> DataFrame:
        raise NotImplementedError


@dataclass
class ActionSeam:
    """What every action passes on its way to its body: rate limit, then audit. ``rows``: (session_id, kind, subject, outcome, detail)."""

    namespace_id: str
    session_id: str
    limiter: Any = None  # acquire(key)
    rows: list[tuple] = field(default_factory=list)

    def call(self, capability: Capability, f: Callable, args: tuple, kwargs: dict) -> Any:
        if f.rate_limit is not None and self.limiter is not None:
            self.limiter.acquire(f"{self.namespace_id}:{capability.capability_id}")
        # Names of parameters are told, values are not.
        names = [*list(inspect.signature(f).parameters)[1 : 1 + len(args)], *kwargs]
        told = json.dumps({n: REDACTED for n in names}, sort_keys=True)
        subject = f"{capability.capability_id}.{f.__name__}"
        try:
            out = f(capability, *args, **kwargs)
        except Exception:
            self.rows.append((self.session_id, "capability_action", subject, "failed", told))
            raise
        self.rows.append((self.session_id, "capability_action", subject, "succeeded", told))
        return out


def action(limit: str | None = None) -> Callable:
    """Marks a capability's public method: every call is audited with redacted parameters; ``limit`` names its rate limit.

    A capability that no seam is bound to cannot act: there is no way around the audit.
    """

    def mark(f: Callable) -> Callable:
        @functools.wraps(f)
        def seamed(self, *args, **kwargs):
            if self.seam is None:
                raise UnauditedActionError(f"{type(self).__name__}.{f.__name__} is called outside a session")
            return self.seam.call(self, f, args, kwargs)

        f.rate_limit = limit
        seamed.is_action, seamed.rate_limit = True, limit
        return seamed

    return mark


class Capability(_Declared):
    """A provider of ``kinds``. Instances live in a process and cannot be shipped, so ``activate`` runs once in each that needs one."""

    capability_id: str
    kinds: tuple[str, ...] = ()
    seam: ActionSeam | None = None

    def bind(self, seam: ActionSeam) -> Capability:
        """The same connection seen from one session."""
        bound = copy.copy(self)
        bound.seam = seam
        return bound

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        if not getattr(cls, "capability_id", None):
            cls.capability_id = cls.__name__
        for name, f in cls.__dict__.items():
            if inspect.isfunction(f) and not name.startswith("_") and name not in ("activate", "bind") and not getattr(f, "is_action", False):
                raise UnauditedActionError(f"{cls.__name__}.{name} is public but no action")

    def activate(self, credentials: dict) -> None:
        """Connects; called before the first action in a process."""


@dataclass
class CapabilityView:
    """The available capabilities by kind, preferred ones first, then by id. ``by_namespace`` overrides the order."""

    available: dict[str, tuple[str, ...]] = field(default_factory=dict)  # capability_id: kinds
    preferred: tuple[str, ...] = ()

    def resolve(self, kind: str) -> list[str]:
        rank = {c: i for i, c in enumerate(self.preferred)}
        return sorted((c for c, kinds in self.available.items() if kind in kinds or kind == c), key=lambda c: (rank.get(c, len(rank)), c))

    def require(self, kind: str) -> str:
        found = self.resolve(kind)
        if not found:
            raise CapabilityUnavailableError(f"nothing provides {kind!r}")
        return found[0]


@dataclass
class SessionCapabilities:
    """What each runnable session may use now: ``offers`` has (session_id, kind, capability_id, rank), gated, preferred ones first; it is made when first asked for."""

    make: Callable[[], DataFrame]
    sessions: DataFrame

    @functools.cached_property
    def offers(self) -> DataFrame:
        return self.make()

    def resolve(self, kind: str) -> DataFrame:
        """(session_id, capability_id, rank) of all providers of the kind, or of the capability by its own id."""
        return self.offers.filter(F.col("kind") == kind).select("session_id", "capability_id", "rank")

    def require(self, kind: str) -> DataFrame:
        """(session_id, capability_id): the first provider of each session; raises if a session has none."""
        first = self.resolve(kind).filter("rank = 1").select("session_id", "capability_id")
        bare = self.sessions.join(first, "session_id", "left_anti").limit(5).collect()
        if bare:
            raise CapabilityUnavailableError(f"nothing provides {kind!r} in sessions {sorted(r['session_id'] for r in bare)}")
        return first

    def of(self, session_id: str) -> CapabilityView:
        """One session's view; its rows are a handful."""
        rows = sorted((r["rank"], r["capability_id"], r["kind"]) for r in self.offers.filter(F.col("session_id") == session_id).collect())
        kinds: dict[str, tuple[str, ...]] = {}
        for _, c, k in rows:
            kinds[c] = (*kinds.get(c, ()), k)
        return CapabilityView(kinds, tuple(dict.fromkeys(c for _, c, _ in rows)))


def undeclared(types_emitted: set[str], operator: Operator, types: TypeRegistry) -> list[str]:
    """Emitted types that no declared one covers; they are merged anyway and reported once."""
    allowed = {leaf for p in operator.produces for leaf in types.leaves(p)}
    return sorted(types_emitted - allowed)
