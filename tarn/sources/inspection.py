"""Inspection of sources and comparison with what the catalog declares."""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.catalog import Catalog, LogicalType, Representation, Source
from tarn.errors import SourceError
from tarn.sources.connections import Connections
from tarn.sources.readers import open_resource

WHOLE = {"byte", "short", "integer", "long"}
REAL = WHOLE | {"float", "double", "decimal"}
#: Families of Spark types that each logical type accepts.
ACCEPTS: dict[LogicalType, set[str]] = {
    LogicalType.ID: WHOLE | {"string"},
    LogicalType.STRING: {"string"},
    LogicalType.TEXT: {"string"},
    LogicalType.INT: WHOLE,
    LogicalType.FLOAT: REAL,
    LogicalType.BOOL: {"boolean"},
    LogicalType.TIMESTAMP: {"timestamp", "timestamp_ntz", "date"},
    LogicalType.UUID: {"string"},
    LogicalType.JSON: {"string", "variant", "struct", "map", "array"},
    LogicalType.BYTES: {"binary"},
}


@dataclass(frozen=True)
class Finding:
    """One disagreement between catalog and source, in logical names only."""

    code: str
    source: str
    dataset: str | None = None
    field: str | None = None


@dataclass
class Inspection:
    """What a source holds: per dataset its columns with type families and, once its ids were read, rows and uniqueness."""

    source: str
    columns: dict[str, dict[str, str]] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    unique: dict[str, bool] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    findings: list[Finding] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        return not self.findings


def family(kind: T.DataType) -> str:
    return kind.typeName().split("(")[0]


def identity_counts(frame: DataFrame, columns: list[str]) -> tuple[int, bool]:
    """(rows, whether the identity is unique and never null), by one aggregation with partial counts."""
    keys = frame.groupBy(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns))).agg(F.count("*").alias("n"))
    empty = F.lit(False)
    for i in range(len(columns)):
        empty = empty | F.col(f"k{i}").isNull()
    found = keys.agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.count_if(empty).alias("nulls")).first()
    return found.rows or 0, (found.most or 0) <= 1 and not found.nulls


def check_identity(found: Inspection, dataset: str, held: Representation) -> bool:
    """Whether the ids of a dataset in this source are unique and never null; read at the first call, remembered after it."""
    if dataset not in found.unique:
        columns = [held.columns[i] for i in held.identity]
        found.rows[dataset], found.unique[dataset] = identity_counts(found.frames[dataset], columns)
    return found.unique[dataset]


def _inspect_dataset(found: Inspection, name: str, held: Representation, frame: DataFrame, catalog: Catalog, ids: bool) -> None:
    found.columns[name] = {c.name: family(c.dataType) for c in frame.schema.fields}
    missing = False
    for logical, physical in held.columns.items():
        if physical not in found.columns[name]:
            found.findings.append(Finding("field_not_found", found.source, name, logical))
            missing |= logical in held.identity
        elif found.columns[name][physical] not in ACCEPTS[catalog.datasets[name].fields[logical].type]:
            found.findings.append(Finding("field_type_incompatible", found.source, name, logical))
    found.frames[name] = frame
    if ids and not missing and not check_identity(found, name, held):
        found.findings.append(Finding("identity_not_unique", found.source, name, "id"))


def inspect_source(
    spark: SparkSession, name: str, source: Source, catalog: Catalog, connections: Connections, *, ids: bool = True
) -> Inspection:
    """Open every resource of a source and compare it with the catalog; with ``ids`` all its ids are read."""
    found = Inspection(name)
    try:
        address = connections.resolve(source.connection_ref)
    except SourceError as error:
        found.findings.append(Finding(error.code.value, name))
        return found
    for dataset, held in source.datasets.items():
        try:
            frame = open_resource(spark, source.kind, held.resource, address)
            frame.schema  # noqa: B018  (resolves the resource)
        except SourceError as error:
            found.findings.append(Finding(error.code.value, name, dataset))
        except (PySparkException, Py4JJavaError):
            found.findings.append(Finding("resource_not_found", name, dataset))
        else:
            _inspect_dataset(found, dataset, held, frame, catalog, ids)
    return found
