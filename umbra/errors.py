"""What the engine raises to a caller on the driver; faults of single rows are columns (error, reason, faults)."""

from __future__ import annotations


class UmbraError(Exception):
    """Any error of this package, with a code and what else is known."""

    code = "error"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


class ValidationError(UmbraError, ValueError):
    code = "validation"


class PolicyError(ValidationError):
    code = "policy"


class DocumentError(UmbraError):
    code = "document"


class MapError(UmbraError):
    code = "map"


class DetectionError(UmbraError):
    code = "detection"


class TooManyFailures(UmbraError):
    code = "failures"
