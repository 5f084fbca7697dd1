"""The active catalog: inspected, validated and replaced as a whole or not at all."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from tarn.catalog import Catalog
from tarn.errors import CatalogError, RuntimeStateError
from tarn.sources.connections import Connections
from tarn.sources.inspection import Finding, Inspection, inspect_source


@dataclass(frozen=True)
class Snapshot:
    """One catalog with the inspections that validated it."""

    catalog: Catalog
    inspections: dict[str, Inspection]
    evaluated_at: datetime


@dataclass(frozen=True)
class Refresh:
    """``activated``, ``rejected`` (with findings) or ``load_failed`` (with the reason)."""

    outcome: str
    findings: tuple[Finding, ...] = ()
    reason: str | None = None
    by_source: dict[str, tuple[Finding, ...]] = field(default_factory=dict)


class CatalogRuntime:
    """Holds the active snapshot; a candidate that fails leaves the old one in place.

    With ``ids`` every id of every source is read before a catalog is activated.
    """

    def __init__(self, spark: SparkSession, load: Callable[[], Catalog], connections: Connections, *, ids: bool = True):
        self._spark, self._load, self._connections, self._ids = spark, load, connections, ids
        self._active: Snapshot | None = None
        self._lock = threading.Lock()

    @property
    def active(self) -> Snapshot | None:
        return self._active

    def require_active(self) -> Snapshot:
        if self._active is None:
            raise RuntimeStateError("catalog_runtime_uninitialized", "No catalog is active.")
        return self._active

    def refresh(self) -> Refresh:
        with self._lock:
            try:
                catalog = self._load()
            except CatalogError as error:
                return Refresh("load_failed", reason=str(error))
            found = {
                name: inspect_source(self._spark, name, source, catalog, self._connections, ids=self._ids)
                for name, source in catalog.sources.items()
            }
            by_source = {name: tuple(i.findings) for name, i in found.items()}
            findings = tuple(f for i in found.values() for f in i.findings)
            if findings:
                return Refresh("rejected", findings, by_source=by_source)
            self._active = Snapshot(catalog, found, datetime.now(UTC))
            return Refresh("activated", by_source=by_source)
