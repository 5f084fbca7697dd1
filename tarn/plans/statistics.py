"""What is known of sources before a query reads them, and how many records are expected from it."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from typing import Any, Protocol

from pyspark.sql import functions as F

from tarn.operators.assemble import owners
from tarn.operators.scan import scan
from tarn.plans.binding import Side
from tarn.plans.request import Comparison, Group, Negation
from tarn.runtime import Snapshot

# The shares of records assumed to pass a condition on a field that nothing is known of.
EQUAL, RANGE, NULL, MATCH = 0.05, 1 / 3, 0.02, 0.1


@dataclass(frozen=True)
class FieldFigures:
    """Of a field's values: how many differ, the share of nulls, shares of common ones, the least and the greatest."""

    distinct: float | None = None
    null_share: float | None = None
    common: Mapping[Any, float] = field(default_factory=dict)
    least: Any = None
    most: Any = None


class Statistics(Protocol):
    """Figures by logical names; None, or a failure, is 'unknown'."""

    def rows(self, source: str, dataset: str) -> float | None: ...

    def field(self, source: str, dataset: str, name: str) -> FieldFigures | None: ...


class MeasuredStatistics:
    """Figures measured on the active sources, each once an activation: row counts come from file footers where they can."""

    def __init__(self, snapshot: Callable[[], Snapshot]):
        self._snapshot = snapshot
        self._held: tuple[Snapshot | None, dict] = (None, {})

    def _once(self, key: tuple, measure: Callable[[Snapshot], Any]) -> Any:
        snapshot = self._snapshot()
        if self._held[0] is not snapshot:
            self._held = snapshot, {}
        known = self._held[1]
        if key not in known:
            known[key] = measure(snapshot)
        return known[key]

    def rows(self, source: str, dataset: str) -> float | None:
        return self._once((source, dataset), lambda s: float(s.inspections[source].frames[dataset].count()))

    def field(self, source: str, dataset: str, name: str) -> FieldFigures | None:
        def measure(snapshot: Snapshot) -> FieldFigures:
            column = F.col(f"`{name}`")
            one = scan(snapshot, source, dataset, (name,)).agg(
                F.approx_count_distinct(column), F.avg(column.isNull().cast("double")), F.min(column), F.max(column)
            ).first()
            return FieldFigures(one[0], one[1], {}, one[2], one[3])

        return self._once((source, dataset, name), measure)


def _number(value: Any) -> float | None:
    if isinstance(value, datetime):
        return (value if value.tzinfo else value.replace(tzinfo=UTC)).timestamp()
    if isinstance(value, date):
        return float(value.toordinal() * 86400)
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return None
    return float(value)


def _below(figures: FieldFigures, value: Any) -> float | None:
    """The share of values under one, as if they lay evenly between the least and the greatest."""
    low, high, at = _number(figures.least), _number(figures.most), _number(value)
    if low is None or high is None or at is None:
        return None
    if high == low:
        return float(at > low)
    return min(1.0, max(0.0, (at - low) / (high - low)))


def _equal(figures: FieldFigures, value: Any) -> float:
    if value in figures.common:
        return figures.common[value]
    if _number(value) is not None and (below := _below(figures, value)) is not None and (below <= 0 or below >= 1):
        if _number(value) not in (_number(figures.least), _number(figures.most)):
            return 0.0
    if not figures.distinct:
        return EQUAL
    rest = max(0.0, 1 - sum(figures.common.values()))
    return rest / max(1.0, figures.distinct - len(figures.common))


def share(where: Any, figures: Callable[[str], FieldFigures]) -> float:
    """The share of records that a bound filter is expected to keep; conditions count as independent."""
    if where is None:
        return 1.0
    if isinstance(where, Negation):
        return 1 - share(where.member, figures)
    if isinstance(where, Group):
        parts = [share(m, figures) for m in where.members]
        return math.prod(parts) if where.kind == "all" else 1 - math.prod(1 - p for p in parts)
    if not isinstance(where, Comparison):
        return MATCH
    known = figures(where.field)
    nulls = NULL if known.null_share is None else known.null_share
    if where.operator == "is_null":
        return nulls
    if where.operator == "is_not_null":
        return 1 - nulls
    if where.operator in ("contains", "starts_with"):
        return MATCH * (1 - (known.null_share or 0))
    held = 1 - (known.null_share or 0)
    if where.operator in ("gt", "gte", "lt", "lte"):
        below = _below(known, where.value)
        kept = RANGE if below is None else below if where.operator in ("lt", "lte") else 1 - below
    elif where.operator in ("eq", "ne"):
        kept = min(1.0, _equal(known, where.value))
        kept = 1 - kept if where.operator == "ne" else kept
    else:
        kept = min(1.0, sum(_equal(known, v) for v in set(where.value)))
        kept = 1 - kept if where.operator == "not_in" else kept
    return kept * held


def expected_records(statistics: Statistics, snapshot: Snapshot, side: Side) -> float | None:
    """How many records a side's filter is expected to leave, at least one; None if their number is unknown."""
    parts = owners(snapshot, side)
    owner = {f: s for s, fields in parts.fields.items() for f in fields}

    def ask(call: Callable[[], Any]) -> Any:
        try:
            return call()
        except Exception:  # noqa: BLE001  (a provider that fails knows nothing)
            return None

    total = ask(lambda: statistics.rows(parts.anchor, side.dataset))
    if total is None:
        return None

    def figures(name: str) -> FieldFigures:
        source = owner.get(name, parts.anchor)
        known = ask(lambda: statistics.field(source, side.dataset, name)) or FieldFigures()
        held = ask(lambda: statistics.rows(source, side.dataset)) if source != parts.anchor else total
        if held is None or not total or held >= total:
            return known
        # A record without a row in a contributor has nulls for its fields.
        present = held / total
        nulls = 1 - present * (1 - (known.null_share or 0))
        return FieldFigures(known.distinct, nulls, known.common, known.least, known.most)

    return max(1.0, total * share(side.where, figures))
