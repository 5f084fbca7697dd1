"""Filters as Spark columns; SQL's three-valued logic comes with them."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.plans.request import Comparison, Group, Negation
from tarn.plans.terms import TERMS, Custom

LONG = range(-(1 << 63), 1 << 63)
WHOLE = re.compile(r"\s*[+-]?\d+\s*\Z")
WHOLE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
BINARY: dict[str, Callable[[Any, Any], Column]] = {
    "eq": operator.eq,
    "ne": operator.ne,
    "gt": operator.gt,
    "gte": operator.ge,
    "lt": operator.lt,
    "lte": operator.le,
}


def known(column: Column, truth: bool) -> Column:
    """A fixed answer for every value but null, which stays unknown."""
    return F.when(column.isNotNull(), F.lit(truth))


def as_stored(value: Any, kind: T.DataType) -> Any:
    """A bound literal for a column's stored type; None if no stored value can equal it."""
    if isinstance(kind, WHOLE_TYPES) and isinstance(value, str):
        value = int(value) if WHOLE.match(value) else None
    if isinstance(kind, WHOLE_TYPES) and type(value) is int and value not in LONG:
        return None
    return value


def as_column(value: Any) -> Column:
    if isinstance(value, datetime):
        return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return F.lit(value)


def compare(column: Column, kind: T.DataType, node: Comparison) -> Column:
    name, value = node.operator, node.value
    if name == "is_null":
        return column.isNull()
    if name == "is_not_null":
        return column.isNotNull()
    if name == "contains":
        return column.contains(value)
    if name == "starts_with":
        return column.startswith(value)
    if name in ("in", "not_in"):
        stored = [as_column(s) for v in value if (s := as_stored(v, kind)) is not None]
        found = column.isin(*stored) if stored else known(column, False)
        return found if name == "in" else ~found
    stored = as_stored(value, kind)
    if stored is None:
        above = isinstance(value, int) and value > 0
        return known(column, name == "ne" or (name in ("lt", "lte") and above) or (name in ("gt", "gte") and not above))
    return BINARY[name](column, as_column(stored))


def condition(where: Any, column: Callable[[str], Column], kind: Callable[[str], T.DataType]) -> Column:
    """A bound filter as one column over the fields that ``column`` finds."""
    if isinstance(where, Comparison):
        return compare(column(where.field), kind(where.field), where)
    if isinstance(where, Custom):
        return TERMS[where.key].column(where.body, column)
    if isinstance(where, Negation):
        return ~condition(where.member, column, kind)
    if isinstance(where, Group):
        parts = [condition(m, column, kind) for m in where.members]
        return reduce(operator.and_ if where.kind == "all" else operator.or_, parts)
    raise TypeError(f"not a filter: {type(where).__name__}")
