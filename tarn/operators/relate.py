"""Follows one declared relationship: an equi-join of two assembled sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.plans.binding import Link


def named(prefix: str, name: str) -> str:
    """Internal column names, so that fields of both sides never clash."""
    return f"{prefix}{name}"


def prefixed(frame: DataFrame, prefix: str) -> DataFrame:
    return frame.select(*(F.col(f"`{c}`").alias(named(prefix, c)) for c in frame.columns))


def relate(left: DataFrame, right: DataFrame, link: Link) -> DataFrame:
    """One row per matching pair; with ``optional`` every left row stays.

    The right side comes filtered, so its condition applies before matching.
    Null keys match nothing.  Keys of different stored types meet as text.
    """
    left, right = prefixed(left, "l_"), prefixed(right, "r_")
    a, b = named("l_", link.left_field), named("r_", link.right_field)
    if left.schema[a].dataType.typeName() in ("string",) and right.schema[b].dataType.typeName() != "string":
        right = right.withColumn("__key", F.col(b).cast("string"))
    elif right.schema[b].dataType.typeName() == "string" and left.schema[a].dataType.typeName() != "string":
        left, right = left.withColumn("__left", F.col(a).cast("string")), right.withColumn("__key", F.col(b))
        return left.join(right, F.col("__left") == F.col("__key"), "left" if link.optional else "inner").drop("__left", "__key")
    else:
        right = right.withColumn("__key", F.col(b))
    return left.join(right, F.col(a) == F.col("__key"), "left" if link.optional else "inner").drop("__key")
