"""Vector search: the k nearest ids, under the query's other filters or within a separate store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.catalog import Catalog, Embedding
from tarn.functions.vectors import distance


def find_binding(catalog: Catalog, dataset: str, field: str) -> tuple[str, Embedding, bool] | None:
    """(source, embedding, whether it is a store apart from the text) of a field's vectors."""
    for name, source in catalog.sources.items():
        held = source.datasets.get(dataset)
        if held is not None and field in held.embeddings:
            return name, held.embeddings[field], name != catalog.resolution[dataset].identity_source
    return None


def nearest(frame: DataFrame, query: Sequence[float], binding: Embedding, k: int, vector: str = "__vector") -> DataFrame:
    """The ``k`` rows with the least distance, ties by id; rows without a vector are never among them."""
    ranked = frame.withColumn("distance", distance(F.col(vector), query, binding.metric)).drop(vector)
    return ranked.where(F.col("distance").isNotNull()).orderBy(F.col("distance").asc(), F.col("id").asc()).limit(k)
