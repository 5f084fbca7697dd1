"""Vector distances from built-in higher-order functions, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.catalog import Metric


def _sum(left: Column, right: Column, term) -> Column:
    return F.aggregate(F.zip_with(left, right, term), F.lit(0.0), lambda total, x: total + x)


def distance(vector: Column, query: Sequence[float], metric: Metric) -> Column:
    """Smaller is nearer, for every metric; null vectors and components give null, and so does a zero cosine norm."""
    stored = vector.cast("array<double>")
    given = F.array(*(F.lit(float(x)) for x in query))
    if metric is Metric.L2:
        return F.sqrt(_sum(stored, given, lambda a, b: (a - b) * (a - b)))
    inner = _sum(stored, given, lambda a, b: a * b)
    if metric is Metric.INNER_PRODUCT:
        return -inner
    norms = F.sqrt(_sum(stored, stored, lambda a, b: a * b)) * F.sqrt(F.lit(float(sum(x * x for x in query))))
    return 1 - inner / F.nullif(norms, F.lit(0.0))
