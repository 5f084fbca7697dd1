"""Assembly: one logical record per id, from the sources that own the fields a query uses."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.predicates import condition
from tarn.operators.scan import guarded, scan
from tarn.plans.binding import Side
from tarn.plans.policy import Guards
from tarn.runtime import Snapshot


@dataclass(frozen=True)
class Parts:
    """The participating sources of one side: the identity source first, each with the fields it gives."""

    anchor: str
    fields: dict[str, tuple[str, ...]]

    @property
    def contributors(self) -> tuple[str, ...]:
        return tuple(s for s in self.fields if s != self.anchor)


def owners(snapshot: Snapshot, side: Side) -> Parts:
    """Sources that own a used field; others are never read (no optimiser rule removes an unused left join)."""
    rule = snapshot.catalog.resolution[side.dataset]
    given: dict[str, list[str]] = {rule.identity_source: ["id"]}
    for name in side.spec.fields:
        if name in side.needed and name != "id":
            given.setdefault(rule.field_sources[name], []).append(name)
    return Parts(rule.identity_source, {s: tuple(f) for s, f in given.items()})


def late_sources(parts: Parts, used: set[str]) -> tuple[str, ...]:
    """Contributors that neither filter nor order a query: they can join its page instead of all records."""
    return tuple(s for s in parts.contributors if not used.intersection(parts.fields[s]))


def enrich(frame: DataFrame, snapshot: Snapshot, side: Side, parts: Parts, sources: Iterable[str], guards: Guards) -> DataFrame:
    """Left-join contributors on id."""
    kind = frame.schema["id"].dataType
    for source in sources:
        more = guarded(scan(snapshot, source, side.dataset, ("id", *parts.fields[source])), guards.scan_rows)
        if more.schema["id"].dataType != kind:
            more = more.withColumn("id", F.col("id").try_cast(kind))
        frame = frame.join(more, "id", "left")
    return frame


def assemble(snapshot: Snapshot, side: Side, guards: Guards = Guards(), without: tuple[str, ...] = ()) -> DataFrame:
    """The side's records with all needed fields but those of the sources ``without``, filtered.

    Contributors are left-joined to the identity source on id, so a missing row
    reads as nulls and a contributor's own ids never appear.  The filter stands
    above the joins: where it cannot hold on nulls the optimiser turns the join
    into an inner one and sinks the condition into that source's scan.
    """
    parts = owners(snapshot, side)
    frame = guarded(scan(snapshot, parts.anchor, side.dataset, ("id", *(f for f in parts.fields[parts.anchor] if f != "id"))), guards.scan_rows)
    frame = enrich(frame, snapshot, side, parts, (s for s in parts.contributors if s not in without), guards)
    return frame if side.where is None else frame.where(filter_of(frame, side.where))


def filter_of(frame: DataFrame, where) -> Column:
    return condition(where, lambda name: F.col(f"`{name}`"), lambda name: frame.schema[name].dataType)
