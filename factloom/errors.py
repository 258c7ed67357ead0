"""Errors, by what went wrong: definitions, concurrency, data, control."""

from __future__ import annotations


class FactloomError(Exception):
    """Base of all errors of the library."""


class DefinitionError(FactloomError):
    """A type, operator or flow is declared wrongly; raised on the driver before anything runs."""


class InvalidTypeError(DefinitionError):
    """A fact type without a configuration, or an emission of an abstract or unknown type."""


class DuplicateIdError(DefinitionError):
    """Two types, operators or capabilities of one name."""


class MissingPolicyError(DefinitionError):
    """An operator without a policy."""


class UnboundedCycleError(DefinitionError):
    """A cycle on which an operator has no bound, or one of capabilities alone."""


class InvalidConditionError(DefinitionError):
    """A completion condition of an unknown kind."""


class UnauditedActionError(DefinitionError):
    """A public capability method that is not declared as an action."""


class ConcurrencyError(FactloomError):
    """Another writer was there first."""


class StaleEpochError(ConcurrencyError):
    """A write under an epoch below the highest seen; nothing was written."""


class LockHeldError(ConcurrencyError):
    """The session's lease is held by somebody else."""


class VersionConflictError(ConcurrencyError):
    """A guarded write expected another version."""


class SessionCompleteError(ConcurrencyError):
    """The session is complete and was not asked to reopen."""


class DataError(FactloomError):
    """Rows that must not pass."""


class UnknownTypeError(DataError):
    """Facts of a type that is not registered."""


class InvalidPayloadError(DataError):
    """A known type whose payload does not fit its schema."""


class UnprotectedPiiError(DataError):
    """Personal data would be archived without a key."""


class PiiKeyUnavailableError(DataError):
    """Sealed values cannot be opened without their namespace's key."""


class ControlError(FactloomError):
    """The run cannot go on."""


class GateBlockedError(ControlError):
    """The scheduling gate has not cooled down."""


class CapabilityUnavailableError(ControlError):
    """No available capability provides the required kind."""


class ActivationError(ControlError):
    """A capability failed to activate."""


class OperationTimeoutError(ControlError):
    """An operation took longer than its timeout."""


class StepLimitError(ControlError):
    """A run took more supersteps than allowed: a cycle without an end, not a finished session."""
