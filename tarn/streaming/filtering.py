"""A bound filter and projection over a stream of one source's rows.

Batch queries are the reference semantics; this is an extension.  A stream has
no last row, so orders, pages, relationships and semantic conditions are
refused; assembly is possible with static contributors (stream-static joins).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.client import Database
from tarn.errors import refuse
from tarn.operators.assemble import filter_of, owners
from tarn.operators.scan import scan
from tarn.plans.binding import Binder
from tarn.plans.policy import Limits
from tarn.plans.request import read_request


def stream_records(db: Database, stream: DataFrame, query: Any, limits: Limits = Limits()) -> DataFrame:
    """The records of a query whose identity source is read as ``stream`` (physical columns).

    The result is a streaming frame in append mode; its state is empty, so it
    runs for any length of time in constant memory.
    """
    request = read_request(query, limits)
    if request.order_by or request.first is not None or request.step:
        refuse("query_feature_not_supported", "A stream has no order, page or relationship.", "query")
    snapshot = db._runtime.require_active()
    side = Binder(snapshot.catalog, limits).bind(request).root
    if side.meaning:
        refuse("query_feature_not_supported", "A stream takes no semantic condition.", "where")
    parts = owners(snapshot, side)
    held = snapshot.catalog.sources[parts.anchor].datasets[side.dataset]
    names = ["id", *(f for f in parts.fields[parts.anchor] if f != "id")]
    frame = stream.select(*(F.col(f"`{held.columns[n]}`").alias(n) for n in names))
    for source in parts.contributors:
        frame = frame.join(scan(snapshot, source, side.dataset, ("id", *parts.fields[source])), "id", "left")
    if side.where is not None:
        frame = frame.where(filter_of(frame, side.where))
    return frame.select(*side.select)
