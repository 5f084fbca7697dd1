"""Order, page and projection: the last steps of every query."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.plans.binding import Sort


def ordering(terms: Iterable[Sort], column: Callable[[Sort], str]) -> list[Column]:
    """Nulls last when ascending, first when descending; text by code point."""
    return [
        F.col(f"`{column(t)}`").desc_nulls_first() if t.descending else F.col(f"`{column(t)}`").asc_nulls_last()
        for t in terms
    ]


def page(frame: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """Sort and cut in one step (a top-n, never a full sort) where there is a limit."""
    ordered = frame.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def project(frame: DataFrame, columns: Iterable[tuple[str, str]]) -> DataFrame:
    """(internal, logical) names; dotted logical names are plain column names."""
    return frame.select(*(F.col(f"`{a}`").alias(b) for a, b in columns))
