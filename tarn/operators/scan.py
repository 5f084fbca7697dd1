"""Reads one dataset from one source, under logical names; filters and columns sink to the reader."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import ExecutionError
from tarn.runtime import Snapshot


def scan(snapshot: Snapshot, source: str, dataset: str, fields: Iterable[str], vector_of: str | None = None) -> DataFrame:
    """The given logical fields (and the embedding of one as ``__vector``) of a source's representation."""
    held = snapshot.catalog.sources[source].datasets[dataset]
    frame = snapshot.inspections[source].frames[dataset]
    columns = [_column(frame, held.columns[f]).alias(f) for f in fields]
    if vector_of is not None:
        columns.append(F.col(f"`{held.embeddings[vector_of].column}`").alias("__vector"))
    return frame.select(*columns)


def _column(frame: DataFrame, physical: str):
    column = F.col(f"`{physical}`")
    kind = frame.schema[physical].dataType
    if isinstance(kind, T.DateType):
        return column.cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        return F.to_utc_timestamp(column, F.current_timezone()).cast("timestamp_ntz")
    return column


def guarded(frame: DataFrame, maximum: int | None, code: str = "query_row_limit_exceeded") -> DataFrame:
    """Refuse a frame of more rows than a guard allows; without a guard nothing is counted."""
    if maximum is not None and frame.limit(maximum + 1).count() > maximum:
        raise ExecutionError(code, f"The query would read more than {maximum} rows.")
    return frame


def key_lookup(frame: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose id is among ``keys`` (repeats do no harm); Spark picks a broadcast or shuffled semi-join by size."""
    return frame.join(keys.select("id"), "id", "left_semi")
