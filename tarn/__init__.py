"""A read-only, Spark-native query layer over a declared catalog of logical datasets."""

from importlib import import_module

_HOMES = {
    "tarn.catalog": ("Catalog", "build_catalog", "load_catalog"),
    "tarn.client": ("Database", "connect"),
    "tarn.engine": ("QueryResult",),
    "tarn.errors": ("ErrorCode", "ErrorDetail", "TarnError"),
    "tarn.operators.semantic": ("Candidate", "CostHint", "PowerRecall", "Semantics", "Usage", "Verdict"),
    "tarn.plans.policy": ("Guards", "Limits"),
    "tarn.plans.statistics": ("FieldFigures", "MeasuredStatistics", "Statistics"),
    "tarn.plans.terms": ("Term", "register_term"),
    "tarn.sources.readers": ("register_reader",),
}

__all__ = [name for names in _HOMES.values() for name in names]


def __getattr__(name: str):
    """Public names are imported on first use: worker processes need none of them."""
    for home, names in _HOMES.items():
        if name in names:
            return getattr(import_module(home), name)
    raise AttributeError(name)
