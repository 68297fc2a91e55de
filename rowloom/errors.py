"""Exceptions raised by the engine."""


class NotFittedError(Exception):
    """A learned object is used before it has learned anything."""


class ConstraintsNotMetError(ValueError):
    """Rows break at least one declared constraint."""

    def __init__(self, message="", counts=None):
        super().__init__(message)
        self.message = message
        self.counts = dict(counts or {})


class MissingConstraintColumnError(Exception):
    """A constraint needs columns that the rows do not have."""


class MetadataError(Exception):
    """A table or dataset description is wrong."""


class MetadataNotFittedError(MetadataError):
    """A table description is used before its fields are known."""
