"""Builds one lazy DataFrame per query, and collects no more than its page."""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import cached_property
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.errors import ExecutionError, QueryError
from tarn.operators.assemble import assemble, enrich, late_sources, owners
from tarn.operators.nearest import find_binding, nearest
from tarn.operators.page import ordering, page, project
from tarn.operators.relate import named, relate
from tarn.operators.scan import guarded, key_lookup, scan
from tarn.operators.semantic import (
    SHORTLIST,
    VERIFY_ALL,
    Report,
    SemanticPlan,
    Semantics,
    choose_plan,
    embed_proposition,
    verify_candidates,
)
from tarn.plans.binding import Binder, Bound, Side, fields_of
from tarn.plans.explain import Explanation, explain
from tarn.plans.fingerprints import catalog_fingerprint, query_fingerprint
from tarn.plans.policy import Guards, Limits
from tarn.plans.request import read_request
from tarn.plans.statistics import Statistics, expected_records
from tarn.runtime import CatalogRuntime, Snapshot
from tarn.sources.inspection import check_identity
from tarn.sources.readers import database_error


def plain(value: Any) -> Any:
    """Naive moments are UTC."""
    return value.replace(tzinfo=UTC) if isinstance(value, datetime) and value.tzinfo is None else value


@dataclass
class QueryResult:
    """A lazy ``dataframe``; ``rows`` collects it (a page at most) once."""

    dataframe: DataFrame
    query_fingerprint: str
    catalog_fingerprint: str
    reports: dict[int, Report] = field(default_factory=dict)
    page_size: int = 0
    timeout_seconds: float | None = None
    id_columns: tuple[str, ...] = ("id",)

    @cached_property
    def rows(self) -> tuple[dict[str, Any], ...]:
        names = self.dataframe.columns
        with limited(self.dataframe.sparkSession, self.timeout_seconds):
            found = tuple({n: plain(v) for n, v in zip(names, row, strict=True)} for row in self.dataframe.collect())
        keys = [tuple(row[n] for n in self.id_columns) for row in found]
        if any(k[0] is None for k in keys) or len(set(keys)) < len(keys):
            raise broken_ids()
        return found

    @property
    def exact(self) -> bool:
        return all(r.exact for r in self.reports.values())


def failed(error: BaseException) -> ExecutionError:
    """A failure that a source's database told of, else of the query; neither shows what it was about."""
    code = database_error(error)
    return ExecutionError(code or "query_execution_failed", "The query failed while it ran.", retryable=code == "source_unavailable")


def broken_ids(source: str | None = None) -> ExecutionError:
    where = f"Source '{source}'" if source else "A source"
    return ExecutionError("query_plan_invariant_violation", f"{where} holds missing or repeated ids.", source_name=source)


@contextmanager
def limited(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Cancel this thread's jobs when time is up, and say so; what fails in Spark or a source fails with a code."""
    if seconds is None:
        try:
            yield
        except (PySparkException, Py4JJavaError) as error:
            raise failed(error) from error
        return
    if seconds <= 0:
        raise ExecutionError("query_timeout", "The query took too long.", retryable=True)
    tag, late = f"tarn-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        yield
    except (PySparkException, Py4JJavaError) as error:
        if late.is_set():
            raise ExecutionError("query_timeout", "The query took too long.", retryable=True) from error
        raise failed(error) from error
    except Exception as error:
        if late.is_set() and not isinstance(error, (QueryError, ExecutionError)):
            raise ExecutionError("query_timeout", "The query took too long.", retryable=True) from error
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        runtime: CatalogRuntime,
        *,
        semantics: Semantics | None = None,
        limits: Limits = Limits(),
        guards: Guards = Guards(),
        statistics: Statistics | None = None,
    ):
        self.spark, self.runtime = spark, runtime
        self.semantics, self.limits, self.guards, self.statistics = semantics, limits, guards, statistics

    def bind(self, query: Any, snapshot: Snapshot) -> Bound:
        bound = Binder(snapshot.catalog, self.limits).bind(read_request(query, self.limits))
        if self.semantics is None and (bound.root.meaning or (bound.other and bound.other.meaning)):
            raise QueryError("query_feature_not_supported", "No provider is configured for semantic conditions.", "where")
        return bound

    def query(self, query: Any, timeout_seconds: float | None = None) -> QueryResult:
        snapshot = self.runtime.require_active()
        bound = self.bind(query, snapshot)
        deadline = None if timeout_seconds is None else time.monotonic() + timeout_seconds
        reports: dict[int, Report] = {}
        with limited(self.spark, timeout_seconds):
            self._check_ids(snapshot, bound)
            frame = self._build(snapshot, bound, reports, deadline)
        left = None if deadline is None else deadline - time.monotonic()
        return QueryResult(
            frame, query_fingerprint(bound), catalog_fingerprint(snapshot.catalog), reports, bound.limit, left,
            ("id", f"{bound.link.alias}.id") if bound.link else ("id",),
        )

    def _check_ids(self, snapshot: Snapshot, bound: Bound) -> None:
        """Refuse to assemble records from a source whose ids are not unique.

        The ids of each source that takes part are read once for each
        activation, at its first query; with declared keys that are trusted
        (``Guards.trusted_ids``) never.  What a page holds is always checked.
        """
        if self.guards.trusted_ids:
            return
        for side in filter(None, (bound.root, bound.other)):
            for source in owners(snapshot, side).fields:
                held = snapshot.catalog.sources[source].datasets[side.dataset]
                if not check_identity(snapshot.inspections[source], side.dataset, held):
                    raise broken_ids(source)

    def explain(self, query: Any) -> Explanation:
        snapshot = self.runtime.require_active()
        bound = self.bind(query, snapshot)
        plans = {k: self._plan(snapshot, s, bound, None) for k, s in enumerate((bound.root, bound.other)) if s and s.meaning}
        # Semantic conditions are verified and guards count while a frame is built, so neither is built here.
        lazy = not plans and (self.guards.scan_rows, self.guards.joined_rows, self.guards.sorted_rows) == (None, None, None)
        sides = [s for s in (bound.root, bound.other) if s]
        expected = {s.dataset: n for s in sides if (n := self._expected(snapshot, s)) is not None}
        return explain(snapshot, bound, plans, self._build(snapshot, bound, {}, None) if lazy else None, expected)

    def _build(self, snapshot: Snapshot, bound: Bound, reports: dict[int, Report], deadline: float | None) -> DataFrame:
        if bound.link is None and bound.root.meaning is None:
            return self._single(snapshot, bound)
        left = self._records(snapshot, bound, 0, reports, deadline)
        if bound.other is None or bound.link is None:
            guarded(left, self.guards.sorted_rows, "query_coordinator_limit_exceeded")
            cut = page(left, ordering(bound.order, lambda s: s.field), bound.limit)
            return project(cut, [(f, f) for f in bound.root.select])
        joined = relate(left, self._records(snapshot, bound, 1, reports, deadline), bound.link)
        guarded(joined, self.guards.joined_rows, "query_coordinator_limit_exceeded")
        cut = page(joined, ordering(bound.order, lambda s: named("lr"[s.side] + "_", s.field)), bound.limit)
        columns = [(named("l_", f), f) for f in bound.root.select]
        columns += [(named("r_", f), f"{bound.link.alias}.{f}") for f in bound.other.select]
        return project(cut, columns)

    def _single(self, snapshot: Snapshot, bound: Bound) -> DataFrame:
        """One dataset: the page is cut before contributors join that only give fields to it.

        So wide fields of all records are never shuffled for the sake of a page;
        the cut page is sorted again after its joins.
        """
        side, order = bound.root, ordering(bound.order, lambda s: s.field)
        parts = owners(snapshot, side)
        late = late_sources(parts, fields_of(side.where) | {s.field for s in bound.order})
        core = assemble(snapshot, side, self.guards, late)
        guarded(core, self.guards.sorted_rows, "query_coordinator_limit_exceeded")
        cut = page(core, order, bound.limit)
        if late:
            cut = page(enrich(cut, snapshot, side, parts, late, self.guards), order, bound.limit)
        return project(cut, [(f, f) for f in side.select])

    def _records(self, snapshot: Snapshot, bound: Bound, place: int, reports: dict[int, Report], deadline: float | None) -> DataFrame:
        """One side's records: assembled, filtered and, with a semantic condition, verified."""
        side = (bound.root, bound.other)[place]
        if side.meaning is None:
            return assemble(snapshot, side, self.guards)
        base = assemble(snapshot, side, self.guards)
        plan = self._plan(snapshot, side, bound, base)
        # Side by side with a join the page cannot stop verification early: any record may be needed.
        alone = bound.link is None
        if plan.kind == SHORTLIST:
            candidates = self._shortlist(snapshot, side, plan)
        else:
            candidates = base
        order = ordering(bound.order, lambda s: s.field) if alone else [F.col("id").asc_nulls_last()]
        reports[place] = verify_candidates(
            self.semantics, candidates.orderBy(*order), side.meaning.field, side.meaning.proposition, plan,
            bound.limit if alone else None, bound.constraints, deadline,
        )
        ids = list(reports[place].records)
        if len(ids) > self.limits.maximum_list:
            found = self.spark.createDataFrame(pa.table({"id": ids})).select(F.col("id").cast(base.schema["id"].dataType))
            return base.join(found, "id", "left_semi")
        return base.where(F.col("id").isin(ids)) if ids else base.where(F.lit(False))

    def _plan(self, snapshot: Snapshot, side: Side, bound: Bound, base: DataFrame | None) -> SemanticPlan:
        binding = find_binding(snapshot.catalog, side.dataset, side.meaning.field)
        if self.semantics.preference == VERIFY_ALL or binding is None or self.semantics.embedder is None:
            base = None
        pool = None
        if base is not None and self.semantics.preference == "auto":
            pool = self._expected(snapshot, side)
            pool = base.count() if pool is None else math.ceil(pool)
        return choose_plan(self.semantics, snapshot.catalog, side, binding, bound.limit, pool, bound.constraints)

    def _expected(self, snapshot: Snapshot, side: Side) -> float | None:
        """How many records a side is expected to have; None without statistics, or if they do not tell."""
        return None if self.statistics is None else expected_records(self.statistics, snapshot, side)

    def _shortlist(self, snapshot: Snapshot, side: Side, plan: SemanticPlan) -> DataFrame:
        """The nearest candidates under the side's other filters, with their fields."""
        vector = embed_proposition(self.semantics, side.meaning.proposition)
        store = scan(snapshot, plan.source, side.dataset, ("id",), side.meaning.field)
        filtered = assemble(snapshot, side, self.guards)
        if side.where is not None:
            store = key_lookup(store, filtered)
        ids = nearest(store, vector, plan.binding, plan.size).select("id")
        return filtered.join(ids, "id", "left_semi")
