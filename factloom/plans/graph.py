"""The operator graph: edges, cycles, reachability, pruning, pictures. Tens of nodes, so all of it is driver-side."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from factloom.errors import DuplicateIdError, UnboundedCycleError
from factloom.operators.base import Aggregator, Capability, Operator
from factloom.sources.workspace import local
from factloom.types import TypeRegistry

Node = type[Operator] | type[Aggregator] | type[Capability] | Operator | Aggregator | Capability


def node_id(x: Node) -> str:
    return x.capability_id if is_capability(x) else x.operator_id


def is_capability(x: Node) -> bool:
    return isinstance(x, Capability) or (isinstance(x, type) and issubclass(x, Capability))


def check_ids(nodes: Iterable[Node]) -> None:
    seen: set[str] = set()
    for x in nodes:
        if node_id(x) in seen:
            raise DuplicateIdError(f"{node_id(x)!r} is declared twice")
        seen.add(node_id(x))


def effective_produces(x: Node, types: TypeRegistry) -> set[str]:
    """Concrete types that the node may emit: an abstract one stands for all of its leaves."""
    return {leaf for p in getattr(x, "produces", ()) for leaf in types.leaves(p)}


def _meets(produced: str, wanted: str, types: TypeRegistry, both_ways: bool) -> bool:
    return types.matches(produced, wanted) or (both_ways and types.matches(wanted, produced))


def build_edges(nodes: Sequence[Node], types: TypeRegistry, both_ways: bool = False) -> dict[str, set[str]]:
    """Producer to consumer, and provider to requirer. ``both_ways``: a produced ancestor also meets a wanted descendant."""
    edges: dict[str, set[str]] = {node_id(x): set() for x in nodes}
    for a in nodes:
        for b in nodes:
            data = any(_meets(p, d, types, both_ways) for p in (effective_produces(a, types) if not both_ways else getattr(a, "produces", ())) for d in b.depends_on)
            provides = is_capability(a) and any(r in a.kinds or r == a.capability_id for r in b.requires)
            if data or provides:
                edges[node_id(a)].add(node_id(b))
    return edges


def build_uses_edges(nodes: Sequence[Node], types: TypeRegistry) -> dict[str, set[str]]:
    """Weak edges for ``uses``; an operator's own output does not count."""
    edges: dict[str, set[str]] = {node_id(x): set() for x in nodes}
    for a in nodes:
        for b in nodes:
            if node_id(a) != node_id(b) and any(types.matches(p, u) for p in effective_produces(a, types) for u in b.uses):
                edges[node_id(a)].add(node_id(b))
    return edges


def restrict_to_permitted(nodes: Sequence[Node], permitted: Iterable[str] | None) -> list[Node]:
    """Without the capabilities that are not permitted; None permits all."""
    return [x for x in nodes if permitted is None or not is_capability(x) or node_id(x) in set(permitted)]


def find_cycles(edges: dict[str, set[str]]) -> list[list[str]]:
    """Sets of nodes that reach each other, and nodes that reach themselves; sorted."""
    reach = {a: _closure(edges, a) for a in edges}
    out, done = [], set()
    for a in sorted(edges):
        if a in reach[a] and a not in done:
            group = sorted(b for b in reach[a] if a in reach.get(b, ()))
            done |= set(group)
            out.append(group)
    return out


def _closure(edges: dict[str, set[str]], start: str) -> set[str]:
    seen: set[str] = set()
    todo = list(edges.get(start, ()))
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += edges.get(x, ())
    return seen


def validate(nodes: Sequence[Node], types: TypeRegistry, both_ways: bool = False) -> dict[str, set[str]]:
    """The edges, if every operator on a cycle has ``max_cycles`` and no cycle is of capabilities alone."""
    check_ids(nodes)
    edges = build_edges(nodes, types, both_ways)
    by_id = {node_id(x): x for x in nodes}
    for cycle in find_cycles(edges):
        operators = [x for x in cycle if not is_capability(by_id[x])]
        loose = [x for x in operators if by_id[x].policy.max_cycles is None]
        if not operators or loose:
            raise UnboundedCycleError(f"the cycle {cycle} has no bound on {loose or cycle}")
    return edges


def backward_reachable(nodes: Sequence[Node], types: TypeRegistry, sinks: Iterable[str]) -> set[str]:
    """Ids of the operators whose output the sinks need, and of the capabilities that those require.

    Only ``depends_on`` of kept operators is followed: what is needed through ``uses`` alone, or by a capability's ``depends_on``, goes.
    """
    operators = [x for x in nodes if not is_capability(x)]
    wanted, kept = set(sinks), set()
    grown = True
    while grown:
        grown = False
        for x in operators:
            if node_id(x) not in kept and any(types.matches(p, w) for p in effective_produces(x, types) for w in wanted):
                kept.add(node_id(x))
                wanted |= set(x.depends_on)
                grown = True
    need = {r for x in operators if node_id(x) in kept for r in x.requires}
    grown = True
    while grown:
        grown = False
        for c in nodes:
            if is_capability(c) and node_id(c) not in kept and (need & {*c.kinds, c.capability_id}):
                kept.add(node_id(c))
                need |= set(c.requires)
                grown = True
    return kept


def prune(operators: Sequence[Operator], aggregators: Sequence[Aggregator], types: TypeRegistry, completes_on: Iterable[str] | None = ()) -> list[Operator]:
    """Without the operators that nobody consumes. Done only if some consumer declares ``consumes``.

    ``completes_on``: the types that the completion condition names, whose producers stay; None if it cannot be looked into, and then everything stays.
    """
    consumers = [*aggregators, *operators]
    declared = [x for x in consumers if x.consumes]
    if not declared or completes_on is None:
        return list(operators)
    sinks = {t for x in declared for t in x.consumes} | {t for a in aggregators for t in a.depends_on} | set(completes_on)
    kept = backward_reachable(operators, types, sinks) | {node_id(x) for x in operators if x.consumes}
    return [x for x in operators if node_id(x) in kept]


def frames(spark: SparkSession, edges: dict[str, set[str]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as DataFrames."""
    return local(spark, [(x,) for x in sorted(edges)], "node string"), local(spark, [(a, b) for a in sorted(edges) for b in sorted(edges[a])], "src string, dst string")


def safe_name(name: str) -> str:
    """A name that the picture's syntax takes."""
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


def mermaid(nodes: Sequence[Node], types: TypeRegistry) -> str:
    """The graph as Mermaid text; the same declarations give the same text. Weak edges are dotted, capabilities rounded."""
    out = ["flowchart LR"]
    for x in sorted(nodes, key=node_id):
        name = node_id(x)
        out.append(f"  {safe_name(name)}" + (f"([{name}])" if is_capability(x) else f"[{name}]"))
    strong, weak = build_edges(nodes, types), build_uses_edges(nodes, types)
    for arrow, edges in (("-->", strong), ("-.->", weak)):
        out += [f"  {safe_name(a)} {arrow} {safe_name(b)}" for a in sorted(edges) for b in sorted(edges[a]) if arrow == "-->" or b not in strong[a]]
    return "\n".join(out) + "\n"
