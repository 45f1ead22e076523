"""Errors that operators raise on the driver."""

from __future__ import annotations


class EngineError(Exception):
    """Of all errors here."""


class _Prefixed(EngineError):
    prefix = ""

    def __str__(self) -> str:
        return self.prefix + super().__str__()


class ValidationError(_Prefixed):
    prefix = "Validation Error: "


class GraphOperationError(_Prefixed):
    prefix = "Graph Operation Error: "


class StorageError(EngineError):
    pass


class ConflictError(StorageError):
    """Another writer has changed what a commit was made from."""


class CacheError(EngineError):
    pass


class QueryError(EngineError):
    pass


class EventError(EngineError):
    pass


class ConfigurationError(EngineError):
    pass


class AuthenticationError(EngineError):
    pass


class AuthorizationError(EngineError):
    pass


class ResourceNotFoundError(EngineError):
    pass


class NodeNotFoundError(ResourceNotFoundError):
    pass


class EdgeNotFoundError(ResourceNotFoundError):
    pass


class DuplicateResourceError(EngineError):
    pass


class InvalidOperationError(EngineError):
    pass


class RateLimitError(EngineError):
    pass


class ServiceUnavailableError(EngineError):
    pass


class PathValidationError(EngineError):
    pass
