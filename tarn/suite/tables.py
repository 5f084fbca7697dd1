"""A logical catalog over the generated tables, and deterministic providers for semantic conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from tarn.catalog import API_VERSION, Catalog, build_catalog
from tarn.client import Database, connect
from tarn.operators.semantic import VERIFY_ALL, Candidate, Semantics, Usage, Verdict
from tarn.plans.policy import Guards

#: dataset: {field: (type, source, column)}; the id's source is the identity source.
DATASETS: dict[str, dict[str, tuple[str, str, str]]] = {
    "customer": {
        "id": ("id", "customer", "c_custkey"),
        "name": ("string", "customer", "c_name"),
        "nation_id": ("id", "customer", "c_nationkey"),
        "balance": ("float", "customer", "c_acctbal"),
        "segment": ("string", "customer", "c_mktsegment"),
    },
    "order": {
        "id": ("id", "orders", "o_orderkey"),
        "customer_id": ("id", "orders", "o_custkey"),
        "status": ("string", "orders", "o_orderstatus"),
        "total": ("float", "orders", "o_totalprice"),
        "ordered_at": ("timestamp", "orders", "o_orderdate"),
        "priority": ("string", "orders", "o_orderpriority"),
    },
    "nation": {
        "id": ("id", "nation", "n_nationkey"),
        "name": ("string", "nation", "n_name"),
        "region_id": ("id", "nation", "n_regionkey"),
    },
    "region": {"id": ("id", "region", "r_regionkey"), "name": ("string", "region", "r_name")},
    "supplier": {
        "id": ("id", "supplier", "s_suppkey"),
        "name": ("string", "supplier", "s_name"),
        "nation_id": ("id", "supplier", "s_nationkey"),
        "balance": ("float", "supplier", "s_acctbal"),
    },
    "part": {
        "id": ("id", "part", "p_partkey"),
        "name": ("string", "part", "p_name"),
        "brand": ("string", "part", "p_brand"),
        "kind": ("string", "part", "p_type"),
        "size": ("int", "part", "p_size"),
        "price": ("float", "part", "p_retailprice"),
    },
    "event": {
        "id": ("id", "events", "event_id"),
        "at": ("timestamp", "events", "ts"),
        "user_id": ("id", "events", "user_id"),
        "kind": ("string", "events", "event_type"),
        "value": ("float", "events", "value"),
        "props": ("json", "events", "props"),
    },
    "document": {
        "id": ("id", "documents", "doc_id"),
        "body": ("text", "documents", "text"),
        "lang": ("string", "documents", "lang"),
        "source": ("string", "documents", "source"),
        "length": ("int", "documents", "n_chars"),
        "quality": ("int", "labels", "quality"),
        "toxic": ("int", "labels", "toxic"),
        "cluster": ("int", "embeddings", "label"),
    },
    "page": {"id": ("id", "pages", "page_id"), "url": ("string", "pages", "url"), "html": ("text", "pages", "html")},
}
IDENTITIES = {("document", "labels"): "doc_id", ("document", "embeddings"): "vec_id", ("order", "lineitem"): "l_orderkey", ("vector", "documents"): "doc_id"}
INTERNAL = {("page", "html")}
RELATIONSHIPS = {
    "customer_orders": ("customer.id", "order.customer_id", "one_to_many", ["placed"]),
    "customer_events": ("customer.id", "event.user_id", "one_to_many", []),
    "nation_customers": ("nation.id", "customer.nation_id", "one_to_many", []),
    "nation_suppliers": ("nation.id", "supplier.nation_id", "one_to_many", []),
    "region_nations": ("region.id", "nation.region_id", "one_to_many", []),
    "nation_siblings": ("nation.region_id", "nation.region_id", "many_to_many", []),
}
DIMENSIONS = 64


def documents(datasets: dict = DATASETS, metric: str = "cosine") -> tuple[dict, dict, dict]:
    """The three catalog documents."""
    described, sources, resolution = {}, {}, {}
    for name, fields in datasets.items():
        described[name] = {"description": f"{name} records", "fields": {}}
        anchor = fields["id"][1]
        resolution[name] = {"identity_source": anchor, "field_sources": {f: s for f, (_, s, _) in fields.items()}}
        for field, (kind, source, column) in fields.items():
            spec = {"type": kind, "description": field, "semantic_eligible": kind == "text"}
            if (name, field) in INTERNAL:
                spec |= {"visibility": "internal", "semantic_eligible": False}
            described[name]["fields"][field] = spec
            held = sources.setdefault(source, {"kind": "parquet", "connection_ref": "lake", "read_only": True, "datasets": {}})
            one = held["datasets"].setdefault(name, {"resource": f"{source}.parquet", "identity": ["id"], "fields": {}})
            one["fields"][field] = {"physical_name": column}
            if source != anchor:
                one["fields"]["id"] = {"physical_name": IDENTITIES[name, source]}
            if name in ("document", "vector") and source == "embeddings":
                binding = {"column": "embedding", "model": "test-64", "dimensions": DIMENSIONS, "metric": metric}
                one["embeddings"] = {"body": binding}
    owner = {(n, f): s for n, fields in datasets.items() for f, (_, s, _) in fields.items()}
    relations = {}
    for name, (start, goal, cardinality, aliases) in RELATIONSHIPS.items():
        a, b = start.split("."), goal.split(".")
        if a[0] in datasets and b[0] in datasets:
            ends = [{"source": owner[d, f], "field": f} for d, f in (a, b)]
            relations[name] = {
                "from": a[0], "to": b[0], "description": name, "cardinality": cardinality, "direction": "bi",
                "aliases": aliases, "implementations": [{"from": ends[0], "to": ends[1]}],
            }
    return (
        {"api_version": API_VERSION, "catalog": {"name": "suite", "version": 1}, "datasets": described},
        {"api_version": API_VERSION, "sources": sources, "resolution": resolution},
        {"api_version": API_VERSION, "relationships": relations},
    )


def catalog(metric: str = "cosine") -> Catalog:
    return build_catalog(*documents(metric=metric))


def proposition_vector(length: int = DIMENSIONS) -> list[float]:
    """The vector that stands for every proposition."""
    return [((7 * k) % 13 - 6) / 8 for k in range(length)]


class FixedEmbedder:
    model, dimensions = "test-64", DIMENSIONS

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [proposition_vector() for _ in texts]


class KeywordVerifier:
    """True of a text that contains the proposition's last word; confidence follows the text's length."""

    model, maximum_batch = "keyword", 64

    def verify(self, proposition: str, candidates: Sequence[Candidate], timeout: float | None):
        word = proposition.split()[-1].lower()
        verdicts = [Verdict(c.id, word in c.text.lower(), len(c.text) % 11 / 10) for c in candidates]
        return verdicts, Usage(calls=1, cost=float(len(candidates)))


_open: dict[tuple, Database] = {}


def database(spark: SparkSession, sf_dir: str, semantic: str | None = None, guards: Guards = Guards(), metric: str = "cosine") -> Database:
    """The open catalog over one folder of tables; inspected once for each session and folder, ids at first use.

    Where everything is to be verified, that is as many candidates as there are.
    """
    key = (spark.sparkContext.applicationId, sf_dir, semantic, guards, metric)
    if key not in _open:
        providers = None
        if semantic:
            most = None if semantic == VERIFY_ALL else Semantics.maximum_candidates
            providers = Semantics(KeywordVerifier(), FixedEmbedder(), preference=semantic, maximum_candidates=most)
        _open[key] = connect(catalog(metric), {"lake": sf_dir}, spark=spark, semantic=providers, guards=guards)
    return _open[key]
