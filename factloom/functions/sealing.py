"""Hashing, sealing and redaction of values."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.errors import PiiKeyUnavailableError, UnprotectedPiiError
from factloom.types import TypeRegistry

REDACTED = "<redacted>"


@dataclass
class Cipher:
    """A namespace's key: seals and opens values, and makes keyed hashes. Sealing is randomised, so never group on what is sealed."""

    key: bytes  # 16, 24 or 32 bytes

    def seal(self, value: Column) -> Column:
        return F.base64(F.aes_encrypt(value.cast("binary"), F.lit(self.key)))

    def unseal(self, value: Column) -> Column:
        return F.aes_decrypt(F.unbase64(value), F.lit(self.key)).cast("string")

    def mac(self, session: Column, value: Column) -> Column:
        """HMAC-SHA-256 over session, NUL and value: personal data is never hashed without a key."""
        key = self.key

        @F.pandas_udf("string")
        def run(data: pd.Series) -> pd.Series:
            return data.map(lambda x: None if x is None else hmac.new(key, x.encode(), hashlib.sha256).hexdigest())

        return run(F.concat(session, F.lit("\x00"), value))


@dataclass
class CipherProvider:
    """Ciphers by namespace."""

    keys: dict[str, bytes] = field(default_factory=dict)

    def namespaces(self) -> list[str]:
        return sorted(self.keys)

    def by_namespace(self, namespace: Column, what: Callable[[Cipher], Column], otherwise: Column) -> Column:
        out = None
        for name in self.namespaces():
            c = what(Cipher(self.keys[name]))
            out = F.when(namespace == name, c) if out is None else out.when(namespace == name, c)
        return otherwise if out is None else out.otherwise(otherwise)


def value_hash(value_key: Column) -> Column:
    return F.sha2(value_key, 256)


def seal_facts(facts: DataFrame, types: TypeRegistry, ciphers: CipherProvider) -> DataFrame:
    """Facts with ``value_hash`` and sealed personal values. The hash is taken first. Raises if a namespace with personal data has no key."""
    pii = F.col("type").isin(types.flagged("pii"))
    if not facts.filter(pii & ~F.coalesce(F.col("namespace_id").isin(ciphers.namespaces()), F.lit(False))).isEmpty():
        raise UnprotectedPiiError("personal data in a namespace without a key")
    hashed = F.when(pii, ciphers.by_namespace(F.col("namespace_id"), lambda c: c.mac(F.col("session_id"), F.col("value_key")), F.lit(None).cast("string"))).otherwise(value_hash(F.col("value_key")))
    sealed = F.when(pii, ciphers.by_namespace(F.col("namespace_id"), lambda c: c.seal(F.col("value")), F.lit(None).cast("string"))).otherwise(F.col("value"))
    out = facts.withColumn("value_hash", hashed).withColumn("value", sealed)
    return out.withColumn("sealed", pii).withColumn("value_key", F.when(pii, F.lit(None).cast("string")).otherwise(F.col("value_key")))


def unseal_facts(facts: DataFrame, ciphers: CipherProvider) -> DataFrame:
    """The opened facts; raises if a sealed row's namespace has no key."""
    if not facts.filter(F.col("sealed") & ~F.coalesce(F.col("namespace_id").isin(ciphers.namespaces()), F.lit(False))).isEmpty():
        raise PiiKeyUnavailableError("sealed rows in a namespace without a key")
    opened = ciphers.by_namespace(F.col("namespace_id"), lambda c: c.unseal(F.col("value")), F.col("value"))
    return facts.withColumn("value", F.when(F.col("sealed"), opened).otherwise(F.col("value")))


def audit_summary(types: TypeRegistry, override: Column | None = None, ciphers: CipherProvider | None = None) -> Column:
    """What the audit says of a value: an override, a sealed or redacted form of personal data, or the value."""
    pii = F.col("type").isin(types.flagged("pii"))
    hidden = F.lit(REDACTED) if ciphers is None else ciphers.by_namespace(F.col("namespace_id"), lambda c: c.seal(F.col("value")), F.lit(REDACTED))
    out = F.when(pii, hidden).otherwise(F.col("value"))
    return out if override is None else F.coalesce(override, out)


def redact_parameters(parameters: Column) -> Column:
    """A map of parameters without their values."""
    return F.transform_values(parameters, lambda k, v: F.lit(REDACTED))


PENDING = "pending:"


def pending_state(epoch: int) -> str:
    """The stored form of an effect that an epoch has claimed."""
    return f"{PENDING}{epoch}"


def pending_epoch(state: Column) -> Column:
    """The claiming epoch; null for other or malformed states."""
    return F.when(F.startswith(state, F.lit(PENDING)), F.try_to_number(F.nullif(F.regexp_extract(state, "^pending:([0-9]+)$", 1), F.lit("")), F.lit("9" * 18)).cast("long"))
