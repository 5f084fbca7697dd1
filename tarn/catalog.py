"""The declared catalog: logical datasets, the sources that hold them, and relationships."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import StrEnum
from pathlib import Path
from typing import Any

import yaml

from tarn.errors import CatalogError
from tarn.sources.readers import READERS

API_VERSION = "tarn/v1"
IDENTIFIER = re.compile(r"[a-z][a-z0-9_]*\Z")
FILES = ("datasets.yaml", "sources.yaml", "relations.yaml")


class LogicalType(StrEnum):
    ID = "id"
    STRING = "string"
    TEXT = "text"
    INT = "int"
    FLOAT = "float"
    BOOL = "bool"
    TIMESTAMP = "timestamp"
    UUID = "uuid"
    JSON = "json"
    BYTES = "bytes"


class Metric(StrEnum):
    COSINE = "cosine"
    L2 = "l2"
    INNER_PRODUCT = "inner_product"


#: Kinds that a catalog may name without there being a reader; those with one are ``readers.READERS``.
DECLARED_KINDS = ("neo4j",)
CARDINALITIES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")


@dataclass(frozen=True)
class Field:
    type: LogicalType
    description: str
    aliases: tuple[str, ...] = ()
    example_values: tuple[Any, ...] = ()
    public: bool = True
    semantic_eligible: bool = False


@dataclass(frozen=True)
class Dataset:
    description: str
    fields: Mapping[str, Field]
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Embedding:
    """A vector column with embeddings of one text field; callers never name it."""

    column: str
    model: str
    dimensions: int
    metric: Metric = Metric.COSINE
    version: str = "1"


@dataclass(frozen=True)
class Representation:
    """How one source holds one dataset: a resource, its identity, and logical to physical names."""

    resource: str
    identity: tuple[str, ...]
    columns: Mapping[str, str]
    embeddings: Mapping[str, Embedding] = field(default_factory=dict)


@dataclass(frozen=True)
class Source:
    kind: str
    connection_ref: str
    datasets: Mapping[str, Representation]


@dataclass(frozen=True)
class Resolution:
    identity_source: str
    field_sources: Mapping[str, str]


@dataclass(frozen=True)
class Implementation:
    from_source: str
    from_field: str
    to_source: str
    to_field: str
    edge_type: str | None = None


@dataclass(frozen=True)
class Relationship:
    from_dataset: str
    to_dataset: str
    description: str
    cardinality: str
    both_ways: bool
    implementations: tuple[Implementation, ...]
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Catalog:
    name: str
    version: int
    datasets: Mapping[str, Dataset]
    sources: Mapping[str, Source]
    resolution: Mapping[str, Resolution]
    relationships: Mapping[str, Relationship]


def _wrong(where: str, what: str):
    raise CatalogError("catalog_load_failed", f"{where}: {what}", where)


class Node:
    """One value of a catalog document with its place; reads are strict about types and unknown keys."""

    def __init__(self, value: Any, where: str):
        self.value, self.where = value, where

    def mapping(self, required: str = "", optional: str = "") -> dict[str, Node]:
        if not isinstance(self.value, dict) or not all(isinstance(k, str) for k in self.value):
            _wrong(self.where, "must be a mapping")
        allowed = {*required.split(), *optional.split()}
        for key in self.value:
            if allowed and key not in allowed:
                _wrong(f"{self.where}.{key}", "is not a known key")
        for key in required.split():
            if key not in self.value:
                _wrong(self.where, f"must have '{key}'")
        return {k: Node(v, f"{self.where}.{k}") for k, v in self.value.items()}

    def named(self) -> dict[str, Node]:
        """A non-empty mapping whose keys are lower_snake_case names."""
        found = self.mapping()
        if not found:
            _wrong(self.where, "must not be empty")
        for key, node in found.items():
            if not IDENTIFIER.match(key):
                _wrong(node.where, "must be a lower_snake_case name")
        return found

    def is_a(self, kind: type, what: str) -> Any:
        if type(self.value) is not kind:
            _wrong(self.where, f"must be {what}")
        return self.value

    def text(self) -> str:
        return self.is_a(str, "a string")

    def filled(self) -> str:
        if not self.text().strip():
            _wrong(self.where, "must not be blank")
        return self.value

    def flag(self) -> bool:
        return self.is_a(bool, "true or false")

    def whole(self) -> int:
        if self.is_a(int, "a whole number") <= 0:
            _wrong(self.where, "must be positive")
        return self.value

    def items(self) -> list[Node]:
        return [Node(v, f"{self.where}[{k}]") for k, v in enumerate(self.is_a(list, "a list"))]

    def texts(self) -> tuple[str, ...]:
        return tuple(n.text() for n in self.items())

    def one_of(self, names: tuple[str, ...]) -> str:
        if self.text() not in names:
            _wrong(self.where, f"must be one of {', '.join(names)}")
        return self.value


def _field(node: Node) -> Field:
    keys = node.mapping("type description", "aliases example_values visibility semantic_eligible")
    get = keys.get
    return Field(
        LogicalType(keys["type"].one_of(tuple(LogicalType))),
        keys["description"].text(),
        get("aliases", Node([], "")).texts(),
        tuple(n.value for n in get("example_values", Node([], "")).items()),
        get("visibility", Node("public", "")).one_of(("public", "internal")) == "public",
        get("semantic_eligible", Node(False, "")).flag(),
    )


def _dataset(node: Node) -> Dataset:
    keys = node.mapping("description fields", "aliases")
    fields = {name: _field(n) for name, n in keys["fields"].named().items()}
    if "id" not in fields or fields["id"].type is not LogicalType.ID or not fields["id"].public:
        _wrong(node.where, "must have a public field 'id' of type 'id'")
    return Dataset(keys["description"].text(), fields, keys.get("aliases", Node([], "")).texts())


def _embedding(node: Node) -> Embedding:
    keys = node.mapping("column model dimensions", "metric version")
    return Embedding(
        keys["column"].filled(),
        keys["model"].filled(),
        keys["dimensions"].whole(),
        Metric(keys.get("metric", Node("cosine", "")).one_of(tuple(Metric))),
        keys.get("version", Node("1", "")).text(),
    )


def _representation(node: Node) -> Representation:
    keys = node.mapping("resource identity fields", "embeddings")
    columns = {n: m.mapping("physical_name")["physical_name"].filled() for n, m in keys["fields"].named().items()}
    identity = keys["identity"].texts()
    if not identity:
        _wrong(keys["identity"].where, "must not be empty")
    embeddings = keys.get("embeddings", Node({}, "")).mapping()
    return Representation(
        keys["resource"].filled(), identity, columns, {n: _embedding(e) for n, e in embeddings.items()}
    )


def _source(node: Node) -> Source:
    keys = node.mapping("kind connection_ref read_only datasets")
    if keys["read_only"].value is not True:
        _wrong(keys["read_only"].where, "must be true")
    datasets = {n: _representation(r) for n, r in keys["datasets"].named().items()}
    return Source(keys["kind"].one_of((*READERS, *DECLARED_KINDS)), keys["connection_ref"].filled(), datasets)


def _endpoint(node: Node) -> tuple[str, str]:
    keys = node.mapping("source field")
    return keys["source"].text(), keys["field"].text()


def _relationship(node: Node) -> Relationship:
    keys = node.mapping("from to description cardinality direction implementations", "aliases")
    made = []
    for item in keys["implementations"].items():
        one = item.mapping("from to", "edge_type")
        edge = one["edge_type"].value if "edge_type" in one else None
        made.append(Implementation(*_endpoint(one["from"]), *_endpoint(one["to"]), edge))
    if not made:
        _wrong(keys["implementations"].where, "must not be empty")
    return Relationship(
        keys["from"].text(),
        keys["to"].text(),
        keys["description"].text(),
        keys["cardinality"].one_of(CARDINALITIES),
        keys["direction"].one_of(("uni", "bi")) == "bi",
        tuple(made),
        keys.get("aliases", Node([], "")).texts(),
    )


def build_catalog(datasets: Any, sources: Any, relations: Any) -> Catalog:
    """A catalog of three documents; reads nothing else."""
    first = Node(datasets, "datasets.yaml").mapping("api_version catalog datasets")
    second = Node(sources, "sources.yaml").mapping("api_version sources resolution")
    third = Node(relations, "relations.yaml").mapping("api_version relationships")
    for document in (first, second, third):
        document["api_version"].one_of((API_VERSION,))
    about = first["catalog"].mapping("name version")
    if not IDENTIFIER.match(about["name"].text()):
        _wrong(about["name"].where, "must be a lower_snake_case name")
    resolution = {}
    for name, node in second["resolution"].named().items():
        keys = node.mapping("identity_source field_sources")
        owners = {f: n.text() for f, n in keys["field_sources"].mapping().items()}
        resolution[name] = Resolution(keys["identity_source"].text(), owners)
    catalog = Catalog(
        about["name"].value,
        about["version"].whole(),
        {n: _dataset(d) for n, d in first["datasets"].named().items()},
        {n: _source(s) for n, s in second["sources"].named().items()},
        resolution,
        {n: _relationship(r) for n, r in third["relationships"].named().items()},
    )
    _check(catalog)
    return catalog


def load_catalog(folder: str | Path) -> Catalog:
    """Read and check the three YAML files of a folder; no source is contacted."""
    documents = []
    for name in FILES:
        try:
            documents.append(yaml.safe_load((Path(folder) / name).read_text(encoding="utf-8")))
        except FileNotFoundError:
            _wrong(name, "is missing")
        except yaml.YAMLError as error:
            _wrong(name, f"is not YAML ({type(error).__name__})")
    return build_catalog(*documents)


def _check(catalog: Catalog) -> None:
    """What the documents must agree on."""
    embedded: set[tuple[str, str]] = set()
    for source_name, source in catalog.sources.items():
        for name, held in source.datasets.items():
            where = f"sources.{source_name}.datasets.{name}"
            spec = catalog.datasets.get(name) or _wrong(where, "is not a dataset")
            if not held.resource.strip():
                _wrong(where, "must name a resource")
            for logical in (*held.columns, *held.identity, *held.embeddings):
                if logical not in spec.fields:
                    _wrong(f"{where}.{logical}", "is not a field of the dataset")
            if held.identity != ("id",) or "id" not in held.columns:
                _wrong(f"{where}.identity", "must be the mapped field 'id'")
            for logical in held.embeddings:
                if spec.fields[logical].type not in (LogicalType.STRING, LogicalType.TEXT) or not spec.fields[logical].semantic_eligible:
                    _wrong(f"{where}.embeddings.{logical}", "must be a semantic_eligible text field")
                if (name, logical) in embedded:
                    _wrong(f"{where}.embeddings.{logical}", "is declared twice")
                embedded.add((name, logical))
    for name, spec in catalog.datasets.items():
        rule = catalog.resolution.get(name) or _wrong(f"resolution.{name}", "is missing")
        for logical in spec.fields:
            owner = rule.identity_source if logical == "id" else rule.field_sources.get(logical)
            held = catalog.sources[owner].datasets.get(name) if owner in catalog.sources else None
            if held is None or logical not in held.columns:
                _wrong(f"resolution.{name}.{logical}", "must name a source that maps the field")
        for logical, owner in rule.field_sources.items():
            if logical not in spec.fields or (logical == "id" and owner != rule.identity_source):
                _wrong(f"resolution.{name}.field_sources.{logical}", "does not fit the dataset")
    for name in catalog.resolution:
        if name not in catalog.datasets:
            _wrong(f"resolution.{name}", "is not a dataset")
    for name, relation in catalog.relationships.items():
        for made in relation.implementations:
            types = []
            for side, dataset, source_name, logical in (
                ("from", relation.from_dataset, made.from_source, made.from_field),
                ("to", relation.to_dataset, made.to_source, made.to_field),
            ):
                where = f"relationships.{name}.{side}"
                if dataset not in catalog.datasets or logical not in catalog.datasets[dataset].fields:
                    _wrong(where, "must be a field of a dataset")
                source = catalog.sources.get(source_name)
                if source is None or dataset not in source.datasets or logical not in source.datasets[dataset].columns:
                    _wrong(where, "must be mapped by the source it names")
                types.append(catalog.datasets[dataset].fields[logical].type)
            if types[0] is not types[1]:
                _wrong(f"relationships.{name}", "must join fields of one type")
