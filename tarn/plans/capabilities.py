"""What each kind of source can be asked to do itself, and what the engine does above it."""

from __future__ import annotations

from dataclasses import dataclass

from tarn.sources.readers import READERS

#: Operators of the query language and where they run by default.
OPERATORS = (
    "scan", "project", "filter", "key_lookup", "order", "limit", "top_k", "vector_search", "combine", "join",
    "semantic_verify",
)
PLANNED = ("aggregate", "group_by", "distinct", "union", "multi_hop")
COLUMNAR = {"scan", "project", "filter"}
#: What readers take over; the rest runs in the engine.
PUSHED: dict[str, set[str]] = {
    "parquet": COLUMNAR,
    "orc": COLUMNAR,
    "csv": {"scan", "project", "filter"},
    "json": {"scan", "project", "filter"},
    "table": COLUMNAR,
    "jdbc": COLUMNAR | {"key_lookup", "limit", "top_k", "order"},
    "postgres": COLUMNAR | {"key_lookup", "limit", "top_k", "order"},
}


@dataclass(frozen=True)
class Capability:
    operator: str
    kind: str
    support: str  # source, engine, planned, none


def capabilities() -> list[Capability]:
    found = []
    for kind in [*READERS, "neo4j"]:
        for operator in OPERATORS:
            level = "none" if kind not in READERS else "source" if operator in PUSHED.get(kind, {"scan"}) else "engine"
            found.append(Capability(operator, kind, level))
        found += [Capability(operator, kind, "planned") for operator in PLANNED]
    return found
