"""Digests of what a query and a catalog mean: equal meanings have equal digests."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict
from typing import Any

from tarn.catalog import Catalog
from tarn.plans.binding import Bound, Side
from tarn.plans.request import Comparison, Group, Meaning
from tarn.plans.terms import Custom


def digest(payload: Any) -> str:
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def _filter(where: Any, values: bool) -> Any:
    if where is None:
        return None
    if isinstance(where, Comparison):
        return [where.field, where.operator, *([where.value] if values else [])]
    if isinstance(where, Meaning):
        return ["semantic", where.field, *([where.proposition] if values else [])]
    if isinstance(where, Custom):
        return [where.key, sorted(where.fields), *([where.body] if values else [])]
    if isinstance(where, Group):
        members = [_filter(m, values) for m in where.members]
        return {where.kind: sorted(members, key=lambda m: json.dumps(m, sort_keys=True, default=str))}
    return {"not": _filter(where.member, values)}


def _side(side: Side | None, values: bool) -> Any:
    if side is None:
        return None
    return [side.dataset, sorted(side.select), _filter(side.where, values), _filter(side.meaning, values)]


def query_fingerprint(bound: Bound) -> str:
    """Order of members and of selected fields and the page size do not matter."""
    c = bound.constraints
    return digest(
        [
            bound.scope,
            _side(bound.root, True),
            _side(bound.other, True),
            asdict(bound.link) if bound.link else None,
            [asdict(s) for s in bound.order],
            [c.maximum_results, c.minimum_quality],
        ]
    )


def plan_fingerprint(bound: Bound, strategy: str | None) -> str:
    """The structure of a query's plan; values of filters do not matter."""
    order = [(s.side, s.field) for s in bound.order]
    return digest([_side(bound.root, False), _side(bound.other, False), asdict(bound.link) if bound.link else None, order, strategy])


def catalog_fingerprint(catalog: Catalog) -> str:
    return digest(asdict(catalog))
