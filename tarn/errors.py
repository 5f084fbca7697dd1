"""Structured errors: every refusal names a code, a message and the place in the query it is about."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from enum import StrEnum
from typing import Any, NoReturn

# The codes that callers match on.
ErrorCode = StrEnum(
    "ErrorCode",
    {
        name.upper(): name
        for name in (
            "source_kind_unsupported connection_reference_not_found connection_pool_timeout connection_pool_closed "
            "source_unavailable source_authentication_failed source_permission_denied source_inspection_failed "
            "source_capability_unavailable source_validation_failed catalog_load_failed catalog_runtime_uninitialized "
            "query_shape_invalid query_feature_not_supported dataset_not_found field_not_found field_not_accessible "
            "query_value_type_invalid query_operator_not_supported query_expression_invalid query_limit_invalid "
            "query_catalog_mismatch source_binding_unavailable source_logical_id_unavailable "
            "query_compilation_unsupported query_source_shape_unsupported query_plan_unsupported "
            "query_plan_invariant_violation query_row_limit_exceeded query_coordinator_limit_exceeded "
            "query_semantic_budget_exceeded semantic_provider_unavailable semantic_provider_failed "
            "query_execution_unsupported query_execution_failed query_timeout relationship_not_found "
            "relationship_not_applicable"
        ).split()
    },
)


@dataclass(frozen=True)
class ErrorDetail:
    code: ErrorCode
    message: str
    retryable: bool = False
    source_name: str | None = None
    location: str | None = None
    details: dict[str, Any] = field(default_factory=dict)

    def as_dict(self) -> dict[str, Any]:
        return asdict(self) | {"code": self.code.value}


class TarnError(Exception):
    """Carries one detail that is safe to show: no physical names, paths or values."""

    def __init__(self, code: ErrorCode | str, message: str, location: str | None = None, **more: Any):
        self.detail = ErrorDetail(ErrorCode(code), message, location=location, **more)
        super().__init__(message)

    @property
    def code(self) -> ErrorCode:
        return self.detail.code

    @property
    def retryable(self) -> bool:
        return self.detail.retryable


class CatalogError(TarnError):
    """The catalog files do not form a catalog."""


class SourceError(TarnError):
    """A source cannot be reached or inspected."""


class RuntimeStateError(TarnError):
    """There is no usable active catalog."""


class QueryError(TarnError):
    """The query as submitted cannot be answered."""


class ExecutionError(TarnError):
    """A valid query failed or was stopped while it ran."""


def refuse(code: str, message: str, location: str | None = None) -> NoReturn:
    raise QueryError(code, message, location)
