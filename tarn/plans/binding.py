"""Names, types and limits: a request against one catalog becomes a bound query."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from typing import Any
from uuid import UUID

from tarn.catalog import Catalog, Dataset, Field, LogicalType
from tarn.errors import refuse
from tarn.plans.policy import Limits
from tarn.plans.request import ABSENT, Comparison, Constraints, Group, Meaning, Negation, Request, Step
from tarn.plans.terms import TERMS, Custom

NULL_TESTS = {"is_null", "is_not_null"}
LISTS = {"in", "not_in"}
EQUALITY = {"eq", "ne"} | LISTS | NULL_TESTS
RANGES = {"gt", "gte", "lt", "lte"}
TEXTUAL = {"contains", "starts_with"}
OPAQUE = {LogicalType.JSON, LogicalType.BYTES}


def allowed(operator: str, kind: LogicalType) -> bool:
    if operator in EQUALITY:
        return kind not in OPAQUE
    if operator in RANGES:
        return kind in (LogicalType.INT, LogicalType.FLOAT, LogicalType.TIMESTAMP)
    return kind in (LogicalType.STRING, LogicalType.TEXT)


@dataclass(frozen=True)
class Side:
    """One dataset of a query with what is asked of it; ``keys`` are fields that only the join needs."""

    dataset: str
    spec: Dataset
    select: tuple[str, ...]
    where: Any = None
    meaning: Meaning | None = None
    extra: frozenset[str] = frozenset()

    @property
    def needed(self) -> set[str]:
        return {"id", *self.select, *self.extra, *fields_of(self.where), *([self.meaning.field] if self.meaning else [])}


@dataclass(frozen=True)
class Sort:
    side: int
    field: str
    descending: bool


@dataclass(frozen=True)
class Link:
    relationship: str
    alias: str
    left_field: str
    right_field: str
    optional: bool


@dataclass(frozen=True)
class Bound:
    scope: str
    root: Side
    order: tuple[Sort, ...]
    limit: int
    page: int
    constraints: Constraints
    other: Side | None = None
    link: Link | None = None
    select_given: bool = field(default=True, compare=False)


def fields_of(where: Any) -> set[str]:
    if where is None:
        return set()
    if isinstance(where, (Comparison, Meaning)):
        return {where.field}
    if isinstance(where, Custom):
        return set(where.fields)
    return set().union(*map(fields_of, where.members if isinstance(where, Group) else (where.member,)))


def public_field(spec: Dataset, dataset: str, name: str, at: str) -> Field:
    found = spec.fields.get(name)
    if found is None:
        refuse("field_not_found", f"Dataset '{dataset}' has no field '{name}'.", at)
    if not found.public:
        refuse("field_not_accessible", f"Field '{name}' of dataset '{dataset}' is not accessible.", at)
    return found


def literal(kind: LogicalType, value: Any, at: str) -> Any:
    """A value checked against, and normalised for, a logical type."""
    good = False
    if kind in (LogicalType.ID, LogicalType.STRING, LogicalType.TEXT):
        good = isinstance(value, str) and (kind is not LogicalType.ID or bool(value.strip()))
    elif kind is LogicalType.INT:
        good = type(value) is int
    elif kind is LogicalType.BOOL:
        good = type(value) is bool
    elif kind is LogicalType.FLOAT:
        good = type(value) in (int, float) and math.isfinite(value)
        value = float(value) if good else value
    elif isinstance(value, str) and kind in (LogicalType.UUID, LogicalType.TIMESTAMP):
        try:
            if kind is LogicalType.UUID:
                value, good = str(UUID(value)), True
            else:
                moment = datetime.fromisoformat(value)
                good = moment.tzinfo is not None
                value = moment.astimezone(UTC) if good else value
        except (ValueError, OverflowError):
            good = False
    if not good:
        refuse("query_value_type_invalid", f"The value does not fit the type '{kind}'.", at)
    return value


class Binder:
    def __init__(self, catalog: Catalog, limits: Limits):
        self.catalog, self.limits = catalog, limits

    def bind(self, request: Request) -> Bound:
        spec = self.catalog.datasets.get(request.dataset)
        if spec is None:
            refuse("dataset_not_found", f"There is no dataset '{request.dataset}'.", "from.dataset")
        root = self._side(request.dataset, spec, request.select, request.where, "select", "where")
        other = link = None
        if request.step:
            link, name = self._link(request.dataset, request.step)
            at = "traverse[0]"
            other = self._side(name, self.catalog.datasets[name], request.step.select, request.step.where, f"{at}.select", f"{at}.where")
        order = self._order(request, root, other, link)
        for place in (0, 1):
            side = (root, other)[place]
            if side is not None:
                extra = {s.field for s in order if s.side == place}
                if link:
                    extra.add((link.left_field, link.right_field)[place])
                side = replace(side, extra=frozenset(extra))
                root, other = (side, other) if place == 0 else (root, side)
        page = request.first if request.first is not None else self.limits.default_page
        most = self.limits.maximum_page
        if page > most:
            refuse("query_limit_invalid", f"A page has at most {most} records.", "page.first")
        c = request.constraints
        if c.maximum_results is not None and c.maximum_results > most:
            refuse("query_limit_invalid", f"'maximum_results' is at most {most}.", "constraints.maximum_results")
        if c.minimum_quality is not None and c.minimum_quality > 1:
            refuse("query_limit_invalid", "'minimum_quality' is at most 1.", "constraints.minimum_quality")
        if c.minimum_quality is not None and not (root.meaning or (other and other.meaning)):
            refuse("query_limit_invalid", "'minimum_quality' needs a semantic condition.", "constraints.minimum_quality")
        return Bound(request.scope, root, order, min(page, c.maximum_results or page), page, c, other, link, request.select is not None)

    def _side(self, name: str, spec: Dataset, select: tuple[str, ...] | None, where: Any, at: str, where_at: str) -> Side:
        if select is None:
            select = tuple(f for f, s in spec.fields.items() if s.public)
        for k, one in enumerate(select):
            public_field(spec, name, one, f"{at}[{k}]")
        if "id" not in select:
            select = ("id", *select)
        bound = self._filter(spec, name, where) if where is not None else None
        rest, meanings = split_meanings(bound)
        if len(meanings) > self.limits.semantic_terms:
            refuse("query_feature_not_supported", "A query has one semantic condition.", where_at)
        return Side(name, spec, select, rest, meanings[0] if meanings else None)

    def _filter(self, spec: Dataset, name: str, node: Any) -> Any:
        if isinstance(node, Group):
            return replace(node, members=tuple(self._filter(spec, name, m) for m in node.members))
        if isinstance(node, Negation):
            return replace(node, member=self._filter(spec, name, node.member))
        if isinstance(node, Meaning):
            return self._meaning(spec, name, node)
        if isinstance(node, Custom):
            used = TERMS[node.key].bind(node.body, spec, f"{node.at}.{node.key}")
            for one in used:
                public_field(spec, name, one, f"{node.at}.{node.key}")
            return replace(node, fields=frozenset(used))
        kind = public_field(spec, name, node.field, f"{node.at}.field").type
        if not allowed(node.operator, kind):
            refuse("query_operator_not_supported", f"'{node.operator}' does not apply to fields of type '{kind}'.", f"{node.at}.op")
        at = f"{node.at}.value"
        if node.operator in NULL_TESTS:
            if node.value is not ABSENT:
                refuse("query_value_type_invalid", f"'{node.operator}' takes no value.", at)
            return replace(node, value=None)
        if node.value is ABSENT or node.value is None:
            refuse("query_value_type_invalid", f"'{node.operator}' needs a value that is not null.", at)
        if node.operator not in LISTS:
            return replace(node, value=literal(kind, node.value, at))
        if not isinstance(node.value, list) or not node.value:
            refuse("query_value_type_invalid", f"'{node.operator}' needs a list of values.", at)
        if len(node.value) > self.limits.maximum_list:
            refuse("query_limit_invalid", f"A list has at most {self.limits.maximum_list} values.", at)
        return replace(node, value=tuple(literal(kind, v, f"{at}[{k}]") for k, v in enumerate(node.value)))

    def _meaning(self, spec: Dataset, name: str, node: Meaning) -> Meaning:
        at = f"{node.at}.semantic"
        found = public_field(spec, name, node.field, f"{at}.field")
        if found.type not in (LogicalType.STRING, LogicalType.TEXT) or not found.semantic_eligible:
            refuse("query_operator_not_supported", f"Field '{node.field}' takes no semantic condition.", f"{at}.field")
        if len(node.proposition.strip()) > self.limits.proposition_chars:
            refuse("query_limit_invalid", f"A proposition has at most {self.limits.proposition_chars} characters.", f"{at}.proposition")
        return replace(node, proposition=node.proposition.strip())

    def _link(self, root: str, step: Step) -> tuple[Link, str]:
        at = "traverse[0].relationship"
        found = [(n, r) for n, r in self.catalog.relationships.items() if step.relationship == n or step.relationship in r.aliases]
        if not found:
            refuse("relationship_not_found", f"There is no relationship '{step.relationship}'.", at)
        name, relation = found[0]
        if step.reverse and not relation.both_ways:
            refuse("relationship_not_applicable", f"'{name}' is followed in one direction only.", at)
        start, goal = relation.from_dataset, relation.to_dataset
        if step.reverse:
            start, goal = goal, start
        if start != root:
            refuse("relationship_not_applicable", f"'{name}' does not lead from '{root}' in this direction.", at)
        joined = next((i for i in relation.implementations if i.edge_type is None), None)
        if joined is None:
            refuse("query_feature_not_supported", f"'{name}' is a graph edge, which cannot be followed.", at)
        left, right = joined.from_field, joined.to_field
        if step.reverse:
            left, right = right, left
        for dataset, one in ((root, left), (goal, right)):
            if not self.catalog.datasets[dataset].fields[one].public:
                refuse("field_not_accessible", f"'{name}' joins on an internal field.", at)
        return Link(name, step.alias, left, right, step.optional), goal

    def _order(self, request: Request, root: Side, other: Side | None, link: Link | None) -> tuple[Sort, ...]:
        found: list[Sort] = []
        for term in request.order_by:
            place, name, side = 0, term.field, root
            if link and other and name.startswith(f"{link.alias}."):
                place, name, side = 1, name.split(".", 1)[1], other
            kind = public_field(side.spec, side.dataset, name, f"{term.at}.field").type
            if kind in OPAQUE:
                refuse("query_operator_not_supported", f"Fields of type '{kind}' have no order.", f"{term.at}.field")
            found.append(Sort(place, name, term.descending))
        if link:
            ends = [Sort(0, "id", False), Sort(1, "id", False)]
            found += [e for e in ends if not any((s.side, s.field) == (e.side, e.field) for s in found)]
        elif not found or found[-1].field != "id":
            found.append(Sort(0, "id", False))
        return tuple(found)


def split_meanings(where: Any) -> tuple[Any, list[Meaning]]:
    """The filter without its semantic conditions, which may stand at the top or within 'all' only."""
    if isinstance(where, Meaning):
        return None, [where]
    if isinstance(where, Group) and where.kind == "all":
        rest, found = [], []
        for member in where.members:
            kept, more = split_meanings(member)
            found += more
            if kept is not None:
                rest.append(kept)
        return (replace(where, members=tuple(rest)) if rest else None), found
    if where is not None and (bad := _inner_meaning(where)):
        refuse("query_feature_not_supported", "A semantic condition cannot stand inside 'any' or 'not'.", bad.at)
    return where, []


def _inner_meaning(where: Any) -> Meaning | None:
    if isinstance(where, Meaning):
        return where
    members = where.members if isinstance(where, Group) else (where.member,) if isinstance(where, Negation) else ()
    return next(filter(None, map(_inner_meaning, members)), None)
