"""A flow: what runs, and when a session is done. Its fingerprint tells whether a stored session began under another one."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import timedelta

from factloom.operators.base import Aggregator, Capability, Operator, check_policy
from factloom.plans import completion as conditions
from factloom.plans.graph import check_ids, prune, validate
from factloom.types import TypeRegistry


@dataclass
class Flow:
    name: str
    types: TypeRegistry
    operators: Sequence[Operator] = ()
    aggregators: Sequence[Aggregator] = ()
    capabilities: Sequence[Capability] = ()
    completes_when: object | None = None
    deadline: timedelta = timedelta(seconds=300)
    timeout: timedelta = timedelta(seconds=30)
    park_after: timedelta | None = None
    pruned: list[Operator] = field(init=False)
    edges: dict[str, set[str]] = field(init=False)

    def __post_init__(self) -> None:
        self.operators = [x() if isinstance(x, type) else x for x in self.operators]
        self.aggregators = [x() if isinstance(x, type) else x for x in self.aggregators]
        self.capabilities = [x() if isinstance(x, type) else x for x in self.capabilities]
        for x in [*self.operators, *self.aggregators]:
            check_policy(x)
        check_ids([*self.operators, *self.aggregators, *self.capabilities])
        if self.completes_when is not None:
            self.completes_when = conditions.normalize(self.completes_when)
        self.pruned = prune(self.operators, self.aggregators, self.types, () if self.completes_when is None else conditions.referenced_types(self.completes_when))
        self.edges = validate([*self.pruned, *self.capabilities], self.types)

    def fingerprint(self) -> str:
        """Covers ids, dependencies, products, requirements, rerun rules, cycle bounds and completion; not names, debounce, timeouts or retries."""
        rows = sorted(
            [x.operator_id, sorted(x.depends_on), sorted(getattr(x, "produces", ())), sorted(x.requires), x.policy.rerun_on_new_data, x.policy.rerun_on.value, x.policy.max_cycles]
            for x in [*self.operators, *self.aggregators]
        )
        caps = sorted([c.capability_id, sorted(c.depends_on), sorted(c.requires), sorted(c.kinds)] for c in self.capabilities)
        done = None if self.completes_when is None else conditions.describe(self.completes_when)
        return hashlib.sha256(json.dumps([rows, caps, done]).encode()).hexdigest()

    def drifted(self, stored: str | None) -> bool:
        return stored is not None and stored != self.fingerprint()
