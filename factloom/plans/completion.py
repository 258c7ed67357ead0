"""Completion conditions: a small tree that becomes one boolean per session."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.errors import InvalidConditionError
from factloom.types import TypeRegistry


@dataclass(frozen=True)
class TypePresent:
    name: str


@dataclass(frozen=True)
class AllOf:
    items: tuple


@dataclass(frozen=True)
class AnyOf:
    items: tuple


@dataclass(frozen=True)
class Custom:
    """``test``: from facts to (session_id, satisfied)."""

    test: Callable[[DataFrame], DataFrame]
    label: str = "custom"


def normalize(condition) -> TypePresent | AllOf | AnyOf | Custom:
    """A condition from itself, a type's name, or a function; anything else raises at once."""
    if isinstance(condition, str):
        return TypePresent(condition)
    if isinstance(condition, (TypePresent, Custom)):
        return condition
    if isinstance(condition, (AllOf, AnyOf)):
        return type(condition)(tuple(normalize(x) for x in condition.items))
    if callable(condition):
        return Custom(condition, getattr(condition, "__name__", "custom"))
    raise InvalidConditionError(f"{condition!r} is no completion condition")


def all_of(*items) -> AllOf:
    return AllOf(tuple(normalize(x) for x in items))


def any_of(*items) -> AnyOf:
    return AnyOf(tuple(normalize(x) for x in items))


def describe(condition) -> str:
    c = normalize(condition)
    if isinstance(c, TypePresent):
        return f"present({c.name})"
    if isinstance(c, Custom):
        return c.label
    return ("all" if isinstance(c, AllOf) else "any") + "(" + ", ".join(describe(x) for x in c.items) + ")"


def referenced_types(condition) -> set[str] | None:
    """Every type that the condition names; None if part of it cannot be looked into."""
    c = normalize(condition)
    if isinstance(c, TypePresent):
        return {c.name}
    if isinstance(c, Custom):
        return None
    parts = [referenced_types(x) for x in c.items]
    return None if any(p is None for p in parts) else set().union(*parts)


def _customs(c) -> Iterable[Custom]:
    if isinstance(c, Custom):
        yield c
    elif isinstance(c, (AllOf, AnyOf)):
        for x in c.items:
            yield from _customs(x)


def satisfied(facts: DataFrame, sessions: DataFrame, condition, types: TypeRegistry) -> DataFrame:
    """(session_id, satisfied) for every session; one aggregation for all type tests. No items: all is true, any is false."""
    c = normalize(condition)
    names: list[str] = []
    customs = list(dict.fromkeys(_customs(c)))

    def column(x) -> Column:
        if isinstance(x, TypePresent):
            if x.name not in names:
                names.append(x.name)
            return F.coalesce(F.col(f"_t{names.index(x.name)}"), F.lit(False))
        if isinstance(x, Custom):
            return F.coalesce(F.col(f"_c{customs.index(x)}"), F.lit(False))
        out = F.lit(isinstance(x, AllOf))
        for item in x.items:
            out = (out & column(item)) if isinstance(x, AllOf) else (out | column(item))
        return out

    result = column(c)
    out = sessions.select("session_id").distinct()
    if names:
        out = out.join(facts.groupBy("session_id").agg(*[F.bool_or(F.col("type").isin(types.leaves(n))).alias(f"_t{i}") for i, n in enumerate(names)]), "session_id", "left")
    for i, x in enumerate(customs):
        out = out.join(x.test(facts).select("session_id", F.col("satisfied").alias(f"_c{i}")), "session_id", "left")
    return out.select("session_id", result.alias("satisfied"))
