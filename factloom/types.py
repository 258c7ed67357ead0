"""Fact types: a registry of leaves and abstract ancestors, canonical keys of values, strict parsing."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.errors import DuplicateIdError, InvalidPayloadError, InvalidTypeError, UnknownTypeError
from factloom.sources.workspace import local

FACT_DDL = (
    "session_id string, namespace_id string, type string, value string, value_key string, retrieved_by string, first_retrieved timestamp_ntz, "
    "last_retrieved timestamp_ntz, added_rev bigint, updated_rev bigint, ins_seq bigint"
)
IDENTITY = ("session_id", "type", "value_key")


@dataclass(frozen=True)
class TypeConfig:
    """pii: sealed in the archive and redacted in the audit; ephemeral: never archived; audit_every_emission: no coalescing."""

    pii: bool = False
    ephemeral: bool = False
    audit_every_emission: bool = False


@dataclass(frozen=True)
class FactType:
    name: str
    parents: tuple[str, ...] = ()
    abstract: bool = False
    config: TypeConfig | None = None
    value: str = "string"  # DDL of the value
    is_set: bool = False  # an array whose order and repeats mean nothing


class TypeRegistry:
    """Types by name. A leaf needs a configuration; a dependency on an ancestor is met by any of its leaves."""

    def __init__(self) -> None:
        self._types: dict[str, FactType] = {}
        self.version = 0
        self._lock = threading.Lock()

    def define(self, name: str, *parents: str, abstract: bool = False, config: TypeConfig | None = None, value: str = "string", is_set: bool = False) -> FactType:
        with self._lock:
            if name in self._types:
                raise DuplicateIdError(f"type {name!r} is defined twice")
            if not abstract and config is None:
                raise InvalidTypeError(f"type {name!r} needs a configuration")
            for p in parents:
                if p not in self._types:
                    raise InvalidTypeError(f"type {name!r} names an unknown parent {p!r}")
            made = FactType(name, parents, abstract, config, value, is_set)
            self._types[name] = made
            self.version += 1
            return made

    def __getitem__(self, name: str) -> FactType:
        if name not in self._types:
            raise UnknownTypeError(f"type {name!r} is not registered")
        return self._types[name]

    def __contains__(self, name: str) -> bool:
        return name in self._types

    def names(self) -> list[str]:
        return sorted(self._types)

    def ancestors(self, name: str) -> set[str]:
        """The type and all that it derives from."""
        out, todo = set(), [name]
        while todo:
            x = todo.pop()
            if x not in out:
                out.add(x)
                todo += self[x].parents
        return out

    def leaves(self, name: str) -> list[str]:
        """Concrete types at or below the type."""
        self[name]
        return sorted(x for x, t in self._types.items() if not t.abstract and name in self.ancestors(x))

    def matches(self, name: str, wanted: str) -> bool:
        """True if a fact of ``name`` satisfies a dependency on ``wanted``."""
        return wanted in self.ancestors(name)

    def emittable(self, name: str) -> FactType:
        t = self._types.get(name)
        if t is None or t.abstract:
            raise InvalidTypeError(f"{name!r} is abstract or unknown and cannot be emitted")
        return t

    def lineage(self, spark: SparkSession) -> DataFrame:
        """(leaf, ancestor), reflexive and transitive. As many rows as type pairs: metadata, never data."""
        rows = [(x, a) for x, t in sorted(self._types.items()) if not t.abstract for a in sorted(self.ancestors(x))]
        return local(spark, rows, "leaf string, ancestor string")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(x, t.abstract, bool(t.config and t.config.pii), bool(t.config and t.config.ephemeral), bool(t.config and t.config.audit_every_emission)) for x, t in sorted(self._types.items())]
        return local(spark, rows, "type string, abstract boolean, pii boolean, ephemeral boolean, audit_every_emission boolean")

    def flagged(self, flag: str) -> list[str]:
        return sorted(x for x, t in self._types.items() if t.config and getattr(t.config, flag))

    def check_known(self, facts: DataFrame) -> None:
        """Raises for facts of unregistered or abstract types; the distinct types are few."""
        known = [x for x, t in self._types.items() if not t.abstract]
        bad = [r["type"] for r in facts.select("type").distinct().filter(~F.col("type").isin(known) | F.col("type").isNull()).limit(20).collect()]
        if bad:
            raise UnknownTypeError(f"unregistered types: {sorted(map(str, bad))}")

    def misfit(self) -> Column:
        """True for a value that does not fit its type's schema; extra fields are ignored."""
        bad = F.lit(False)
        for x, t in sorted(self._types.items()):
            if not t.abstract:
                bad = bad | ((F.col("type") == x) & F.col("value").isNotNull() & typed(F.col("value"), t.value).isNull())
        return F.coalesce(bad, F.lit(False))

    def parse(self, facts: DataFrame) -> DataFrame:
        """Checks that each JSON value fits its type's schema, ignoring extra fields; raises InvalidPayloadError otherwise."""
        self.check_known(facts)
        if not facts.filter(self.misfit()).isEmpty():
            raise InvalidPayloadError("payloads do not fit their types")
        return facts.withColumn("value_key", self.value_keys())

    def value_keys(self, value: str = "value", kind: str = "type") -> Column:
        """The canonical key of a JSON value by its type."""
        out = None
        for x, t in sorted(self._types.items()):
            if not t.abstract:
                key = value_key(typed(F.col(value), t.value), t.value, t.is_set)
                out = F.when(F.col(kind) == x, key) if out is None else out.when(F.col(kind) == x, key)
        return out.otherwise(F.col(value)) if out is not None else F.col(value)


def typed(value: Column, ddl: str) -> Column:
    """A JSON value as the type's value; null if it does not fit."""
    return F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), f"v {ddl}", {"mode": "PERMISSIVE"})["v"]


def value_key(value: Column, ddl: str, is_set: bool = False) -> Column:
    """Canonical JSON of a value: maps by sorted entries, sets sorted and distinct, containers tagged so that kinds never meet."""
    return F.to_json(F.struct(_canonical(value, T._parse_datatype_string(ddl), is_set).alias("v")))


def _canonical(c: Column, kind: T.DataType, is_set: bool) -> Column:
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), _canonical(e["value"], kind.valueType, False).alias("v")))
        return F.struct(F.array_sort(entries).alias("m"))
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: _canonical(x, kind.elementType, False))
        return F.struct((F.array_sort(F.array_distinct(items)) if is_set else items).alias("s" if is_set else "a"))
    if isinstance(kind, T.StructType):
        return F.struct(F.struct(*[_canonical(c[f.name], f.dataType, False).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]).alias("o"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(c == 0, F.lit(0.0)).otherwise(c)  # one identity for both zeros
    return c
