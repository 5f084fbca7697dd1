"""Explanations of plans in logical names; physical names and values never appear."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tarn.operators.assemble import late_sources, owners
from tarn.operators.semantic import SHORTLIST, SemanticPlan
from tarn.plans.binding import Bound, Side, fields_of
from tarn.plans.fingerprints import plan_fingerprint, query_fingerprint
from tarn.plans.request import Group
from tarn.runtime import Snapshot


@dataclass(frozen=True)
class PlanNode:
    kind: str
    location: str
    fields: tuple[str, ...] = ()
    pushed_filter_fields: tuple[str, ...] = ()
    residual_filter: bool = False
    ordering: tuple[str, ...] = ()
    limit: int | None = None
    detail: tuple[str, ...] = ()


@dataclass(frozen=True)
class Explanation:
    """Nodes come after their children."""

    plan_kind: str
    query_fingerprint: str
    plan_fingerprint: str
    nodes: tuple[PlanNode, ...]
    notes: tuple[str, ...] = ()


def conjuncts(where) -> list:
    if where is None:
        return []
    if isinstance(where, Group) and where.kind == "all":
        return [c for m in where.members for c in conjuncts(m)]
    return [where]


#: Operators of a physical plan that a note counts.
COUNTED = re.compile(r"(?<![A-Za-z])(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|TakeOrderedAndProject|BroadcastExchange|Exchange|HashAggregate|FileScan|BatchScan)(?=[ (])")


def physical_note(frame: DataFrame) -> str:
    """Which operators Catalyst has chosen before the query runs; names of sources and columns are left out."""
    found = Counter(COUNTED.findall(frame._jdf.queryExecution().executedPlan().toString()))
    return "catalyst: " + ", ".join(f"{n} {name}" for name, n in sorted(found.items()))


def _side_nodes(snapshot: Snapshot, side: Side, bound: Bound, plan: SemanticPlan | None) -> list[PlanNode]:
    parts = owners(snapshot, side)
    alone = bound.link is None and side.meaning is None
    late = late_sources(parts, fields_of(side.where) | {s.field for s in bound.order}) if alone else ()
    owner = {f: s for s, fields in parts.fields.items() for f in fields}
    pushed: dict[str, set[str]] = {s: set() for s in parts.fields}
    rest = False
    for one in conjuncts(side.where):
        sources = {owner[f] for f in fields_of(one)}
        if len(sources) == 1:
            pushed[sources.pop()] |= fields_of(one)
        else:
            rest = True
    nodes = []
    if plan and plan.kind == SHORTLIST and plan.separate:
        nodes.append(PlanNode("vector_search", plan.source or "", limit=plan.size, detail=(str(plan.binding.metric),)))
    for source, fields in parts.fields.items():
        near = plan is not None and plan.kind == SHORTLIST and not plan.separate and source == plan.source
        nodes.append(
            PlanNode("vector_search" if near else "scan", source, fields, tuple(sorted(pushed[source])), limit=plan.size if near else None)
        )
    if parts.contributors:
        nodes.append(PlanNode("combine", "engine", detail=tuple(f"left {c}" + (", on the page only" if c in late else "") for c in parts.contributors)))
    if rest:
        nodes.append(PlanNode("filter", "engine", residual_filter=True))
    if side.meaning:
        nodes.append(PlanNode("semantic_verify", "engine", (side.meaning.field,), detail=plan.reasons if plan else ()))
    return nodes


def explain(
    snapshot: Snapshot, bound: Bound, plans: dict[int, SemanticPlan], frame: DataFrame | None = None, expected: dict[str, float] | None = None
) -> Explanation:
    """The plan of a bound query; ``frame``, its lazy result, is asked for Catalyst's choices and not run.

    ``expected`` has the records that statistics let expect of a dataset, after its filter.
    """
    nodes = _side_nodes(snapshot, bound.root, bound, plans.get(0))
    names = [s.field if s.side == 0 else f"{bound.link.alias}.{s.field}" for s in bound.order]
    fields = list(bound.root.select)
    if bound.other and bound.link:
        nodes += _side_nodes(snapshot, bound.other, bound, plans.get(1))
        kind = "left" if bound.link.optional else "inner"
        nodes.append(PlanNode("join", "engine", (bound.link.left_field, bound.link.right_field), detail=(kind, bound.link.relationship)))
        fields += [f"{bound.link.alias}.{f}" for f in bound.other.select]
    nodes.append(PlanNode("order_page", "engine", ordering=tuple(names), limit=bound.limit))
    nodes.append(PlanNode("project", "engine", tuple(fields)))
    many = len(owners(snapshot, bound.root).fields) > 1
    kind = "join" if bound.link else "combined" if many else "single_source"
    notes = tuple(r for p in plans.values() for r in p.reasons) + ((physical_note(frame),) if frame is not None else ())
    notes += tuple(f"expected records of {name}: {round(n)}" for name, n in (expected or {}).items())
    strategy = ",".join(p.kind for p in plans.values()) or None
    return Explanation(kind, query_fingerprint(bound), plan_fingerprint(bound, strategy), tuple(nodes), notes)
