"""The shape of a query: strict reading of JSON into plain objects, before any name is looked up."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from tarn.errors import refuse
from tarn.plans.policy import Limits
from tarn.plans.terms import TERMS, Custom

OPERATORS = ("eq", "ne", "in", "not_in", "is_null", "is_not_null", "gt", "gte", "lt", "lte", "contains", "starts_with")
ALIAS = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,39}\Z")
ABSENT = object()


@dataclass(frozen=True)
class Comparison:
    field: str
    operator: str
    value: Any
    at: str


@dataclass(frozen=True)
class Group:
    kind: str  # all, any
    members: tuple
    at: str


@dataclass(frozen=True)
class Negation:
    member: Any
    at: str


@dataclass(frozen=True)
class Meaning:
    """A proposition that must be true of a text field."""

    field: str
    proposition: str
    at: str


@dataclass(frozen=True)
class Ordering:
    field: str
    descending: bool
    at: str


@dataclass(frozen=True)
class Constraints:
    maximum_results: int | None = None
    maximum_latency_ms: int | None = None
    maximum_cost: float | None = None
    minimum_quality: float | None = None


@dataclass(frozen=True)
class Step:
    relationship: str
    alias: str
    select: tuple[str, ...] | None
    where: Any
    optional: bool
    reverse: bool


@dataclass(frozen=True)
class Request:
    dataset: str
    scope: str
    select: tuple[str, ...] | None
    where: Any
    order_by: tuple[Ordering, ...]
    first: int | None
    constraints: Constraints
    step: Step | None = None


def _keys(value: Any, at: str, allowed: str, prefix: bool = True) -> Mapping[str, Any]:
    if not isinstance(value, Mapping):
        refuse("query_shape_invalid", f"'{at}' must be an object.", at)
    for key in value:
        if key not in allowed.split():
            refuse("query_shape_invalid", f"'{key}' is not a known key here.", f"{at}.{key}" if prefix else str(key))
    return value


def _name(value: Any, at: str) -> str:
    if not isinstance(value, str) or not value.strip():
        refuse("query_shape_invalid", f"'{at}' must be a non-empty string.", at)
    return value


def _listed(value: Any, at: str) -> list:
    if not isinstance(value, list):
        refuse("query_shape_invalid", f"'{at}' must be a list.", at)
    return value


def _names(value: Any, at: str) -> tuple[str, ...] | None:
    if value is None:
        return None
    found = tuple(_name(v, f"{at}[{k}]") for k, v in enumerate(_listed(value, at)))
    if len(set(found)) < len(found):
        refuse("query_shape_invalid", f"'{at}' names a field twice.", at)
    return found


class FilterReader:
    """Reads one filter; counts its nodes so that walking it later is bounded."""

    def __init__(self, limits: Limits):
        self.limits, self.nodes = limits, 0

    def read(self, value: Any, at: str, depth: int = 1) -> Any:
        self.nodes += 1
        if depth > self.limits.maximum_depth:
            refuse("query_limit_invalid", f"Filters nest at most {self.limits.maximum_depth} levels.", at)
        if self.nodes > self.limits.maximum_terms:
            refuse("query_limit_invalid", f"Filters have at most {self.limits.maximum_terms} terms.", at)
        if not isinstance(value, Mapping):
            refuse("query_shape_invalid", f"'{at}' must be an object.", at)
        if special := [k for k in ("semantic", "all", "any", "not", *TERMS) if k in value]:
            if len(value) > 1:
                refuse("query_expression_invalid", f"'{special[0]}' must stand alone in its object.", at)
            if special[0] in TERMS:
                return Custom(special[0], TERMS[special[0]].read(value[special[0]], f"{at}.{special[0]}"), at)
            return getattr(self, f"_{special[0]}")(value[special[0]], at, depth)
        keys = _keys(value, at, "field op value")
        name, operator = _name(keys.get("field"), f"{at}.field"), _name(keys.get("op"), f"{at}.op")
        if operator not in OPERATORS:
            refuse("query_operator_not_supported", f"There is no operator '{operator}'.", f"{at}.op")
        return Comparison(name, operator, keys.get("value", ABSENT), at)

    def _semantic(self, value: Any, at: str, depth: int) -> Meaning:
        keys = _keys(value, f"{at}.semantic", "field proposition")
        return Meaning(
            _name(keys.get("field"), f"{at}.semantic.field"),
            _name(keys.get("proposition"), f"{at}.semantic.proposition"),
            at,
        )

    def _members(self, kind: str, value: Any, at: str, depth: int) -> Group:
        if not _listed(value, f"{at}.{kind}"):
            refuse("query_expression_invalid", f"'{kind}' needs at least one member.", f"{at}.{kind}")
        return Group(kind, tuple(self.read(v, f"{at}.{kind}[{k}]", depth + 1) for k, v in enumerate(value)), at)

    def _all(self, value: Any, at: str, depth: int) -> Group:
        return self._members("all", value, at, depth)

    def _any(self, value: Any, at: str, depth: int) -> Group:
        return self._members("any", value, at, depth)

    def _not(self, value: Any, at: str, depth: int) -> Negation:
        return Negation(self.read(value, f"{at}.not", depth + 1), at)


def _orderings(value: Any) -> tuple[Ordering, ...]:
    found: list[Ordering] = []
    for k, item in enumerate(_listed(value, "order_by") if value is not None else ()):
        at = f"order_by[{k}]"
        keys = _keys(item, at, "field direction")
        name, direction = _name(keys.get("field"), f"{at}.field"), _name(keys.get("direction"), f"{at}.direction")
        if any(o.field == name for o in found):
            refuse("query_shape_invalid", "'order_by' names a field twice.", f"{at}.field")
        if direction not in ("asc", "desc"):
            refuse("query_shape_invalid", "A direction is 'asc' or 'desc'.", f"{at}.direction")
        found.append(Ordering(name, direction == "desc", at))
    return tuple(found)


def _first(value: Any) -> int | None:
    first = _keys(value, "page", "first").get("first") if value is not None else None
    if first is not None and (type(first) is not int or first <= 0):
        refuse("query_limit_invalid", "'page.first' must be a positive whole number.", "page.first")
    return first


def _constraints(value: Any) -> Constraints:
    if value is None:
        return Constraints()
    kinds = {"maximum_results": (int,), "maximum_latency_ms": (int,), "maximum_cost": (int, float), "minimum_quality": (int, float)}
    keys = _keys(value, "constraints", " ".join(kinds))
    for name, types in kinds.items():
        given = keys.get(name)
        if given is not None and (type(given) not in types or not given > 0):
            refuse("query_limit_invalid", f"'{name}' must be a positive number.", f"constraints.{name}")
    return Constraints(**keys)


def _step(value: Any, limits: Limits) -> Step:
    if not isinstance(value, list) or not value:
        refuse("query_shape_invalid", "'traverse' must be a list of one step.", "traverse")
    if len(value) > 1:
        refuse("query_feature_not_supported", "A query follows one relationship.", "traverse")
    at = "traverse[0]"
    keys = _keys(value[0], at, "relationship as select where optional direction")
    relationship = _name(keys.get("relationship"), f"{at}.relationship")
    alias = keys.get("as", relationship)
    if not isinstance(alias, str) or not ALIAS.match(alias):
        refuse("query_shape_invalid", "'as' must consist of letters, digits and underscores.", f"{at}.as")
    optional, direction = keys.get("optional", False), keys.get("direction", "forward")
    if type(optional) is not bool:
        refuse("query_shape_invalid", "'optional' must be true or false.", f"{at}.optional")
    if direction not in ("forward", "reverse"):
        refuse("query_shape_invalid", "A direction is 'forward' or 'reverse'.", f"{at}.direction")
    where = FilterReader(limits).read(keys["where"], f"{at}.where") if keys.get("where") is not None else None
    return Step(relationship, alias, _names(keys.get("select"), f"{at}.select"), where, optional, direction == "reverse")


def read_request(value: Any, limits: Limits) -> Request:
    """Read a query given as a mapping or as JSON text."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            refuse("query_shape_invalid", "The query is not JSON.", "query")
    if not isinstance(value, Mapping):
        refuse("query_shape_invalid", "A query must be an object.", "query")
    if "semantic" in value:
        refuse("query_feature_not_supported", "'semantic' is a filter term; put it into 'where'.", "semantic")
    keys = _keys(value, "query", "from select where order_by page constraints traverse", prefix=False)
    if "from" not in keys:
        refuse("query_shape_invalid", "A query needs 'from'.", "from")
    origin = _keys(keys["from"], "from", "dataset as")
    dataset = _name(origin.get("dataset"), "from.dataset")
    return Request(
        dataset,
        _name(origin.get("as", dataset), "from.as"),
        _names(keys.get("select"), "select"),
        FilterReader(limits).read(keys["where"], "where") if "where" in keys else None,
        _orderings(keys.get("order_by")),
        _first(keys.get("page")),
        _constraints(keys.get("constraints")),
        _step(keys["traverse"], limits) if "traverse" in keys else None,
    )
