"""Errors raised by the library, with the codes a caller sees for each kind.

``ERROR_CODES`` is also the lookup table of ``operators.catalog.classify_errors``.
"""

from __future__ import annotations

# Error kind -> (code, HTTP status, gRPC status name).
ERROR_CODES = {
    # data source
    "InvalidRequest": ("invalid_request", 400, "INVALID_ARGUMENT"),
    "NoDataError": ("no_data", 404, "NOT_FOUND"),
    "ConfigError": ("config", 500, "INTERNAL"),
    "ConnectionError": ("connection", 503, "UNAVAILABLE"),
    "SQLError": ("sql_error", 400, "INTERNAL"),
    "IOError": ("io_error", 500, "INTERNAL"),
    # document catalog
    "ResourceNotFound": ("not_found", 404, "NOT_FOUND"),
    "Config": ("config", 500, "INTERNAL"),
    "Connection": ("connection", 503, "UNAVAILABLE"),
    "Query": ("query_error", 500, "INTERNAL"),
    "Conflict": ("conflict", 409, "ALREADY_EXISTS"),
    "Serialization": ("serialization", 400, "INTERNAL"),
    "Deserialization": ("deserialization", 400, "INTERNAL"),
    "Validation": ("validation", 400, "INVALID_ARGUMENT"),
    # secret store
    "SecretNotFound": ("secret_not_found", 404, "NOT_FOUND"),
    "Forbidden": ("forbidden", 403, "PERMISSION_DENIED"),
    "CannotCreateSecret": ("cannot_create_secret", 400, "INTERNAL"),
    "CannotDeleteSecret": ("cannot_delete_secret", 400, "INTERNAL"),
    "CannotSetSecretLabels": ("cannot_set_secret_labels", 400, "INTERNAL"),
}
# Fixed value: what an error kind outside the table is reported as.
UNKNOWN_ERROR = ("internal", 500, "INTERNAL")


class GateError(Exception):
    """Base of the library's own errors; ``kind`` is a key of ``ERROR_CODES``."""

    kind = ""

    @property
    def code(self) -> str:
        return ERROR_CODES.get(self.kind, UNKNOWN_ERROR)[0]

    @property
    def http_status(self) -> int:
        return ERROR_CODES.get(self.kind, UNKNOWN_ERROR)[1]


class InvalidRequest(GateError):
    kind = "InvalidRequest"


class NoData(GateError):
    kind = "NoDataError"


class ConfigError(GateError):
    kind = "ConfigError"


class SourceUnavailable(GateError):
    kind = "ConnectionError"


class SqlError(GateError):
    kind = "SQLError"


class NotFound(GateError):
    kind = "ResourceNotFound"


class SecretNotFound(GateError):
    kind = "SecretNotFound"


class ValidationError(GateError):
    kind = "Validation"
