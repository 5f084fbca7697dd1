"""One registered query per operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.catalog import Metric, build_catalog
from tarn.client import connect
from tarn.errors import TarnError
from tarn.operators.nearest import find_binding, nearest
from tarn.operators.scan import key_lookup, scan
from tarn.operators.semantic import CostHint, Semantics
from tarn.plans.capabilities import capabilities
from tarn.plans.fingerprints import catalog_fingerprint
from tarn.plans.policy import Guards
from tarn.plans.terms import Term, register_term
from tarn.sources.connections import Connections
from tarn.sources.inspection import inspect_source
from tarn.sources.readers import register_reader
from tarn.suite.tables import DATASETS, FixedEmbedder, KeywordVerifier, catalog, database, documents, proposition_vector

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Case:
    run: Query
    sql: str | None


CASES: dict[str, Case] = {}


def ask(key: str, query: dict, sql: str, **options) -> None:
    """Register a catalog query under a key."""
    CASES[key] = Case(lambda spark, sf: database(spark, sf, **options).query(query).dataframe, sql)


def rows(spark: SparkSession, schema: str, found: list[tuple]) -> DataFrame:
    return spark.createDataFrame(found, schema)


def values(names: str, found: list[tuple]) -> str:
    literal = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in found)}) t({names})"


def f(field: str, op: str, value=None) -> dict:
    return {"field": field, "op": op} | ({} if value is None else {"value": value})


def by(field: str, direction: str = "asc") -> dict:
    return {"field": field, "direction": direction}


# --- scans -----------------------------------------------------------------

CUSTOMER = "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation_id, c_acctbal AS balance, c_mktsegment AS segment FROM customer"
ORDER = "SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status, o_totalprice AS total, o_orderdate AS ordered_at, o_orderpriority AS priority FROM orders"
DOCUMENT = (
    "SELECT d.doc_id AS id, d.text AS body, d.lang, d.source, d.n_chars AS length, l.quality, l.toxic, e.label AS cluster "
    "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id"
)

ask("scan", {"from": {"dataset": "customer"}}, f"{CUSTOMER} ORDER BY id LIMIT 100")
ask(
    "scan_single_pushed",
    {"from": {"dataset": "customer"}, "where": f("segment", "eq", "BUILDING"), "order_by": [by("balance", "desc")], "page": {"first": 40}},
    f"SELECT * FROM ({CUSTOMER}) WHERE segment = 'BUILDING' ORDER BY balance DESC NULLS FIRST, id LIMIT 40",
)


def _scan_guard(spark: SparkSession, sf: str) -> DataFrame:
    found = []
    for limit in (10, 10_000_000):
        try:
            database(spark, sf, guards=Guards(scan_rows=limit)).query({"from": {"dataset": "supplier"}}).rows
            found.append((str(limit), "answered"))
        except TarnError as error:
            found.append((str(limit), error.code.value))
    return rows(spark, "guard string, outcome string", found)


CASES["scan_guard"] = Case(
    _scan_guard,
    "SELECT g AS guard, CASE WHEN (SELECT count(*) FROM supplier) > CAST(g AS BIGINT) THEN 'query_row_limit_exceeded' "
    "ELSE 'answered' END AS outcome FROM (VALUES ('10'), ('10000000')) t(g)",
)
ask(
    "key_lookup",
    {"from": {"dataset": "order"}, "where": f("id", "in", [str(k) for k in range(1, 900, 7)]), "select": ["status"], "page": {"first": 500}},
    "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey IN "
    f"({', '.join(str(k) for k in range(1, 900, 7))}) ORDER BY id LIMIT 500",
)


def _key_lookup_batched(spark: SparkSession, sf: str) -> DataFrame:
    active = database(spark, sf)._runtime.require_active()
    keys = scan(active, "orders", "order", ("customer_id",)).select(F.col("customer_id").alias("id"))
    return key_lookup(scan(active, "customer", "customer", ("id", "name")), keys)


CASES["key_lookup_batched"] = Case(
    _key_lookup_batched, "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"
)
VECTOR = "[" + ", ".join(f"{x}::DOUBLE" for x in proposition_vector()) + "]"
DISTANCES = {
    Metric.COSINE: "1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), {v})",
    Metric.L2: "list_distance(CAST(embedding AS DOUBLE[]), {v})",
    Metric.INNER_PRODUCT: "-list_inner_product(CAST(embedding AS DOUBLE[]), {v})",
}


def _search(metric: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        active = database(spark, sf, metric=str(metric))._runtime.require_active()
        source, binding, _ = find_binding(active.catalog, "document", "body")
        found = nearest(scan(active, source, "document", ("id",), "body"), proposition_vector(), binding, 50)
        return found.select("id", F.round("distance", 6).alias("distance"))

    return run


for _metric, _sql in DISTANCES.items():
    _ranked = f"SELECT vec_id AS id, {_sql.format(v=VECTOR)} AS d FROM embeddings ORDER BY d, id LIMIT 50"
    CASES[f"vector_search_{_metric}"] = Case(_search(_metric), f"SELECT id, round(d, 6) AS distance FROM ({_ranked})")


def _store_scan(spark: SparkSession, sf: str) -> DataFrame:
    active = database(spark, sf)._runtime.require_active()
    source, binding, _ = find_binding(active.catalog, "document", "body")
    texts = scan(active, "documents", "document", ("id", "lang")).where("lang = 'en'")
    store = key_lookup(scan(active, source, "document", ("id",), "body"), texts)
    return nearest(store, proposition_vector(), binding, 30).select("id")


CASES["vector_store_scan"] = Case(
    _store_scan,
    f"SELECT vec_id AS id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') "
    f"ORDER BY {DISTANCES[Metric.COSINE].format(v=VECTOR)}, vec_id LIMIT 30",
)


def _inspect(spark: SparkSession, sf: str) -> DataFrame:
    with connect(catalog(), {"lake": sf}, spark=spark, check_ids=True) as db:
        active = db._runtime.require_active()
    found = [
        (source, dataset, one.rows[dataset], len(one.columns[dataset]), one.unique[dataset])
        for source, one in active.inspections.items()
        for dataset in one.columns
    ]
    return rows(spark, "source string, dataset string, n_rows long, n_columns long, identity_unique boolean", found)


CASES["inspect"] = Case(
    _inspect,
    " UNION ALL ".join(
        f"SELECT '{s}' AS source, '{d}' AS dataset, (SELECT count(*) FROM {s}) AS n_rows, "
        f"(SELECT count(*) FROM information_schema.columns WHERE table_name = '{s}') AS n_columns, "
        f"(SELECT count(*) = count(DISTINCT {k}) FROM {s}) AS identity_unique"
        for d, s, k in sorted(
            {(d, s, next(c for n, (_, t, c) in fields.items() if n == "id" and t == s) if fields["id"][1] == s else {"labels": "doc_id", "embeddings": "vec_id"}[s])
             for d, fields in DATASETS.items() for _, s, _ in fields.values()}
        )
    ),
)
WRONG = {
    "line": {"id": ("id", "lineitem", "l_orderkey"), "quantity": ("float", "lineitem", "l_quantity")},
    "customer": {"id": ("id", "customer", "c_custkey"), "name": ("int", "customer", "c_name"), "gone": ("string", "customer", "c_gone")},
    "order": {"id": ("id", "missing", "o_orderkey"), "customer_id": ("id", "missing", "o_custkey")},
}


def _validate(spark: SparkSession, sf: str) -> DataFrame:
    catalog = build_catalog(*documents(WRONG))
    found = [
        (one.code, one.source, one.dataset, one.field)
        for name, source in catalog.sources.items()
        for one in inspect_source(spark, name, source, catalog, Connections({"lake": sf})).findings
    ]
    return rows(spark, "code string, source string, dataset string, field string", found)


CASES["validate"] = Case(
    _validate,
    values(
        "code, source, dataset, field",
        [
            ("identity_not_unique", "lineitem", "line", "id"),
            ("field_type_incompatible", "customer", "customer", "name"),
            ("field_not_found", "customer", "customer", "gone"),
            ("resource_not_found", "missing", "order", None),
        ],
    ),
)

# --- projection and predicates ---------------------------------------------

ask("project", {"from": {"dataset": "part"}, "select": ["brand", "size"]}, "SELECT p_partkey AS id, p_brand AS brand, p_size AS size FROM part ORDER BY id LIMIT 100")
ask("project_ids_only", {"from": {"dataset": "part"}, "select": []}, "SELECT p_partkey AS id FROM part ORDER BY id LIMIT 100")


def predicate(key: str, dataset: str, where: dict, sql: str, select: list[str], columns: str, table: str) -> None:
    ask(
        key,
        {"from": {"dataset": dataset}, "select": ["id", *select], "where": where, "page": {"first": 500}},
        f"SELECT {columns} FROM {table} WHERE {sql} ORDER BY id LIMIT 500",
    )


_O = ("order", ["status", "total"], "o_orderkey AS id, o_orderstatus AS status, o_totalprice AS total", "orders")
_P = ("part", ["name", "size"], "p_partkey AS id, p_name AS name, p_size AS size", "part")
_E = ("event", ["at", "kind"], "event_id AS id, ts AS at, event_type AS kind", "events")


def _on(shape: tuple, key: str, where: dict, sql: str) -> None:
    predicate(key, shape[0], where, sql, *shape[1:])


_on(_O, "filter_eq", f("status", "eq", "F"), "o_orderstatus = 'F'")
_on(_O, "filter_ne", f("status", "ne", "F"), "o_orderstatus <> 'F'")
_on(_O, "filter_in", f("priority", "in", ["1-URGENT", "5-LOW"]), "o_orderpriority IN ('1-URGENT', '5-LOW')")
_on(_O, "filter_not_in", f("priority", "not_in", ["1-URGENT", "5-LOW"]), "o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
_on(_O, "filter_gt", f("total", "gt", 300000), "o_totalprice > 300000")
_on(_O, "filter_gte", f("total", "gte", 250000.5), "o_totalprice >= 250000.5")
_on(_O, "filter_lt", f("total", "lt", 40000), "o_totalprice < 40000")
_on(_O, "filter_lte", f("total", "lte", 30000), "o_totalprice <= 30000")
_on(_P, "filter_int_range", {"all": [f("size", "gte", 10), f("size", "lt", 14)]}, "p_size >= 10 AND p_size < 14")
_on(_P, "filter_contains", f("name", "contains", "ring"), "contains(p_name, 'ring')")
_on(_P, "filter_starts_with", f("brand", "starts_with", "Brand#1"), "starts_with(p_brand, 'Brand#1')")
_on(
    _E,
    "filter_timestamp_range",
    {"all": [f("at", "gte", "2024-01-05T02:00:00+02:00"), f("at", "lt", "2024-01-06T00:00:00Z")]},
    "ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 00:00:00'",
)
_on(_O, "filter_id_text", f("id", "eq", "7"), "o_orderkey = 7")
_on(_O, "bool_all", {"all": [f("status", "eq", "O"), f("total", "gt", 200000)]}, "o_orderstatus = 'O' AND o_totalprice > 200000")
_on(_O, "bool_any", {"any": [f("status", "eq", "P"), f("total", "lt", 20000)]}, "o_orderstatus = 'P' OR o_totalprice < 20000")
_on(_O, "bool_not", {"not": f("status", "eq", "O")}, "NOT o_orderstatus = 'O'")
_on(
    _O,
    "filter_nested",
    {"all": [{"any": [f("status", "eq", "F"), f("status", "eq", "P")]}, {"not": {"any": [f("priority", "eq", "1-URGENT"), {"not": f("total", "gte", 100000)}]}}]},
    "(o_orderstatus = 'F' OR o_orderstatus = 'P') AND NOT (o_orderpriority = '1-URGENT' OR NOT o_totalprice >= 100000)",
)

# --- assembly ----------------------------------------------------------------


def doc(key: str, where: dict | None, sql: str, select: list[str], order: list[dict] | None = None, order_sql: str = "id") -> None:
    query = {"from": {"dataset": "document"}, "select": select, "page": {"first": 500}}
    query |= ({"where": where} if where else {}) | ({"order_by": order} if order else {})
    ask(key, query, f"SELECT {', '.join(['id', *select])} FROM ({DOCUMENT}) WHERE {sql} ORDER BY {order_sql} LIMIT 500")


doc("filter_is_null", f("toxic", "is_null"), "toxic IS NULL", ["lang", "toxic"])
doc("filter_is_not_null", f("toxic", "is_not_null"), "toxic IS NOT NULL", ["lang", "toxic"])
doc("combine_enrich", None, "true", ["lang", "quality"])
doc("combine_required", f("quality", "eq", 1), "quality = 1", ["lang", "quality"])
doc("combine_is_null_contributor", f("quality", "is_null"), "quality IS NULL", ["lang", "quality"])
doc("combine_cross_source_or", {"any": [f("lang", "eq", "fr"), f("toxic", "eq", 1)]}, "lang = 'fr' OR toxic = 1", ["lang", "toxic"])
doc("combine_cross_source_not", {"not": {"any": [f("lang", "eq", "en"), f("toxic", "eq", 0)]}}, "NOT (lang = 'en' OR toxic = 0)", ["lang", "toxic"])
doc("combine_three_sources", f("cluster", "gte", 3), "cluster >= 3", ["lang", "quality", "cluster"])
doc("combine_empty_short_circuit", {"all": [f("quality", "eq", 77), f("cluster", "gt", 1)]}, "quality = 77 AND cluster > 1", ["quality", "cluster"])
doc("combine_unused_source", f("length", "gt", 3000), "length > 3000", ["lang", "length"])


_LINES = {
    "id": ("id", "orders", "o_orderkey"),
    "customer_id": ("id", "orders", "o_custkey"),
    "status": ("string", "orders", "o_orderstatus"),
    "quantity": ("float", "lineitem", "l_quantity"),
}


def _id_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Queries on a record whose contributor repeats ids: each is answered, or refused with a code."""
    found = []
    with connect(build_catalog(*documents({"order": _LINES, "customer": DATASETS["customer"]})), {"lake": sf}, spark=spark) as db:
        for select in (["status"], ["status", "quantity"]):
            try:
                outcome = f"{len(db.query({'from': {'dataset': 'order'}, 'select': select, 'page': {'first': 7}}).rows)} rows"
            except TarnError as error:
                outcome = error.code.value
            found.append((",".join(select), outcome))
    return rows(spark, "selected string, outcome string", found)


CASES["combine_id_integrity"] = Case(
    _id_integrity,
    "SELECT 'status' AS selected, least(count(*), 7) || ' rows' AS outcome FROM orders UNION ALL "
    "SELECT 'status,quantity', CASE WHEN count(*) > count(DISTINCT l_orderkey) THEN 'query_plan_invariant_violation' ELSE '7 rows' END FROM lineitem",
)

# --- relationships -----------------------------------------------------------


def follow(key: str, query: dict, sql: str, **options) -> None:
    ask(key, {"page": {"first": 500}} | query, sql, **options)


_CO = 'SELECT c.c_custkey AS id, c.c_name AS name, o.o_orderkey AS "order.id", o.o_orderstatus AS "order.status", o.o_totalprice AS "order.total"'
_step = {"relationship": "customer_orders", "as": "order", "select": ["status", "total"]}
follow(
    "join_inner",
    {"from": {"dataset": "customer"}, "select": ["name"], "where": f("segment", "eq", "MACHINERY"), "traverse": [_step | {"where": f("status", "eq", "F")}]},
    f"{_CO} FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'MACHINERY' AND o.o_orderstatus = 'F' "
    'ORDER BY id, "order.id" LIMIT 500',
)
_EV = 'SELECT c.c_custkey AS id, e.event_id AS "seen.id", e.event_type AS "seen.kind" FROM customer c LEFT JOIN (SELECT * FROM events WHERE event_type = \'click\') e ON c.c_custkey = e.user_id'
follow(
    "join_left",
    {"from": {"dataset": "customer"}, "select": [], "traverse": [{"relationship": "customer_events", "as": "seen", "select": ["kind"], "where": f("kind", "eq", "click"), "optional": True}]},
    f'{_EV} ORDER BY id, "seen.id" NULLS LAST LIMIT 500',
)
follow(
    "join_reverse",
    {"from": {"dataset": "order"}, "select": ["status"], "where": f("total", "gt", 400000), "traverse": [{"relationship": "customer_orders", "as": "buyer", "select": ["name"], "direction": "reverse"}]},
    'SELECT o_orderkey AS id, o_orderstatus AS status, c_custkey AS "buyer.id", c_name AS "buyer.name" FROM orders JOIN customer ON c_custkey = o_custkey '
    'WHERE o_totalprice > 400000 ORDER BY id, "buyer.id" LIMIT 500',
)
follow(
    "join_self",
    {"from": {"dataset": "nation"}, "select": ["name"], "traverse": [{"relationship": "nation_siblings", "as": "sibling", "select": ["name"]}]},
    'SELECT a.n_nationkey AS id, a.n_name AS name, b.n_nationkey AS "sibling.id", b.n_name AS "sibling.name" FROM nation a JOIN nation b '
    'ON a.n_regionkey = b.n_regionkey ORDER BY id, "sibling.id" LIMIT 500',
)
follow(
    "join_by_alias",
    {"from": {"dataset": "customer"}, "select": [], "traverse": [{"relationship": "placed", "select": ["status"]}]},
    'SELECT c_custkey AS id, o_orderkey AS "placed.id", o_orderstatus AS "placed.status" FROM customer JOIN orders ON c_custkey = o_custkey '
    'ORDER BY id, "placed.id" LIMIT 500',
)
follow(
    "join_order_both_sides",
    {"from": {"dataset": "customer"}, "select": ["segment"], "traverse": [_step | {"select": ["status"]}], "order_by": [by("segment"), by("order.total", "desc")], "page": {"first": 200}},
    'SELECT c_custkey AS id, c_mktsegment AS segment, o_orderkey AS "order.id", o_orderstatus AS "order.status" FROM customer JOIN orders ON c_custkey = o_custkey '
    'ORDER BY segment NULLS LAST, o_totalprice DESC NULLS FIRST, id, "order.id" LIMIT 200',
)
follow(
    "join_region_nations",
    {"from": {"dataset": "region"}, "select": ["name"], "traverse": [{"relationship": "region_nations", "as": "nation", "select": ["name"]}]},
    'SELECT r_regionkey AS id, r_name AS name, n_nationkey AS "nation.id", n_name AS "nation.name" FROM region JOIN nation ON r_regionkey = n_regionkey '
    'ORDER BY id, "nation.id" LIMIT 500',
)


def _null_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Null keys over whole tables: every document against one row for each quality, that of none among them."""
    from tarn.operators.relate import relate
    from tarn.plans.binding import Link

    docs = database(spark, sf)._runtime.require_active()
    ids, labels = scan(docs, "documents", "document", ("id",)), scan(docs, "labels", "document", ("id", "toxic", "quality"))
    all_rows = ids.join(labels, "id", "left")
    right = all_rows.groupBy("quality").agg(F.min("id").alias("id"))
    joined = relate(all_rows.select("id", "toxic"), right, Link("x", "x", "toxic", "quality", True))
    return joined.select(F.col("l_id").alias("id"), F.col("r_id").alias("other_id"))


CASES["join_null_keys"] = Case(
    _null_keys,
    "WITH t AS (SELECT d.doc_id, l.toxic, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) "
    "SELECT a.doc_id AS id, b.id AS other_id FROM t a LEFT JOIN (SELECT quality, min(doc_id) AS id FROM t GROUP BY quality) b ON a.toxic = b.quality",
)


def _case_db(spark: SparkSession, sf: str, semantic: str | None = None):
    """The suite's catalog with a dataset of labels that points at documents."""
    from tarn.client import connect
    from tarn.operators.semantic import Semantics
    from tarn.suite.tables import KeywordVerifier

    parts = documents(DATASETS | {"case": {"id": ("id", "labels", "doc_id"), "document_id": ("id", "labels", "doc_id")}})
    ends = {"from": {"source": "labels", "field": "document_id"}, "to": {"source": "documents", "field": "id"}}
    about = {"from": "case", "to": "document", "description": "what a label is about", "cardinality": "one_to_one"}
    parts[2]["relationships"]["case_document"] = about | {"direction": "bi", "implementations": [ends]}
    providers = Semantics(KeywordVerifier(), preference=semantic, maximum_candidates=None) if semantic else None
    return connect(build_catalog(*parts), {"lake": sf}, spark=spark, semantic=providers)


def _multi_source_side(spark: SparkSession, sf: str) -> DataFrame:
    step = {"relationship": "case_document", "as": "d", "select": ["lang", "toxic", "cluster"], "where": f("toxic", "eq", 1)}
    return _case_db(spark, sf).query({"from": {"dataset": "case"}, "select": [], "traverse": [step], "page": {"first": 500}}).dataframe


CASES["join_multi_source_side"] = Case(
    _multi_source_side,
    f'SELECT c.doc_id AS id, d.id AS "d.id", d.lang AS "d.lang", d.toxic AS "d.toxic", d.cluster AS "d.cluster" FROM labels c JOIN ({DOCUMENT}) d '
    'ON c.doc_id = d.id WHERE d.toxic = 1 ORDER BY 1, 2 LIMIT 500',
)

# --- order and pages ----------------------------------------------------------

doc("order_asc", None, "true", ["quality"], [by("quality")], "quality ASC NULLS LAST, id")
doc("order_desc", None, "true", ["quality"], [by("quality", "desc")], "quality DESC NULLS FIRST, id")
doc("order_multi", None, "true", ["lang", "toxic", "length"], [by("lang"), by("toxic", "desc"), by("length")], "lang NULLS LAST, toxic DESC NULLS FIRST, length NULLS LAST, id")
doc("order_id_tiebreak", None, "true", ["lang"], [by("lang", "desc")], "lang DESC NULLS FIRST, id")
doc("order_text_codepoint", None, "true", ["body"], [by("body")], "encode(body) NULLS LAST, id")
ask("page_limit", {"from": {"dataset": "event"}, "select": ["kind"], "page": {"first": 17}}, "SELECT event_id AS id, event_type AS kind FROM events ORDER BY id LIMIT 17")
ask(
    "page_maximum_results",
    {"from": {"dataset": "event"}, "select": ["kind"], "page": {"first": 50}, "constraints": {"maximum_results": 9}},
    "SELECT event_id AS id, event_type AS kind FROM events ORDER BY id LIMIT 9",
)
ask(
    "top_k",
    {"from": {"dataset": "order"}, "select": ["total"], "order_by": [by("total", "desc")], "page": {"first": 25}},
    "SELECT o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY total DESC NULLS FIRST, id LIMIT 25",
)

# --- semantic conditions -----------------------------------------------------

MEANS = {"semantic": {"field": "body", "proposition": "the text mentions on"}}
_HELD = "source = 'src3' AND contains(lower(body), 'on')"
_NEAR = (
    "SELECT e.vec_id FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.source = 'src3' "
    f"ORDER BY {DISTANCES[Metric.COSINE].format(v=VECTOR)}, e.vec_id LIMIT {{k}}"
)


def meaning(key: str, sql: str, plan: str, first: int = 500, more: dict | None = None, **query) -> None:
    ask(
        key,
        {"from": {"dataset": "document"}, "select": ["lang"], "where": {"all": [f("source", "eq", "src3"), MEANS, *([more] if more else [])]}, "page": {"first": first}} | query,
        f"SELECT id, lang FROM ({DOCUMENT}) WHERE {sql} ORDER BY id LIMIT {first}",
        semantic=plan,
    )


meaning("semantic_term", _HELD, "verify_all", first=20)
meaning("semantic_verify_all", _HELD, "verify_all")
meaning("semantic_verify_with_filter", f"{_HELD} AND length > 1000", "verify_all", more=f("length", "gt", 1000))
meaning("semantic_shortlist", f"{_HELD} AND id IN ({_NEAR.format(k=20)})", "vector_shortlist", first=2)
meaning("semantic_store_shortlist", f"{_HELD} AND id IN ({_NEAR.format(k=50)})", "vector_shortlist", first=5)
meaning("semantic_min_quality", f"{_HELD} AND length(body) % 11 >= 5", "verify_all", constraints={"minimum_quality": 0.5})

_NEAR_ALL = f"SELECT e.vec_id FROM embeddings e ORDER BY {DISTANCES[Metric.COSINE].format(v=VECTOR)}, e.vec_id LIMIT {{k}}"
for _key, _first in (("semantic_shortlist_all", 2), ("semantic_store_shortlist_all", 5)):
    ask(
        _key,
        {"from": {"dataset": "document"}, "select": ["lang"], "where": MEANS, "page": {"first": _first}},
        f"SELECT id, lang FROM ({DOCUMENT}) WHERE contains(lower(body), 'on') AND id IN ({_NEAR_ALL.format(k=10 * _first)}) ORDER BY id LIMIT {_first}",
        semantic="vector_shortlist",
    )


_VECTORS = {
    "vector": {
        "id": ("id", "embeddings", "vec_id"),
        "cluster": ("int", "embeddings", "label"),
        "body": ("text", "documents", "text"),
    },
    **{name: DATASETS[name] for name in ("customer", "order")},
}


def _anchor_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors stand in the record's own identity source; the text comes from a contributor."""
    semantics = Semantics(KeywordVerifier(), FixedEmbedder(), preference="vector_shortlist")
    db = connect(build_catalog(*documents(_VECTORS)), {"lake": sf}, spark=spark, semantic=semantics)
    asked = {"from": {"dataset": "vector"}, "select": ["cluster"], "where": {"all": [f("cluster", "lt", 5), MEANS]}, "page": {"first": 6}}
    return db.query(asked).dataframe


CASES["semantic_anchor_shortlist"] = Case(
    _anchor_shortlist,
    "SELECT e.vec_id AS id, e.label AS cluster FROM (SELECT * FROM embeddings WHERE label < 5 "
    f"ORDER BY {DISTANCES[Metric.COSINE].format(v=VECTOR)}, vec_id LIMIT 60) e JOIN documents d ON d.doc_id = e.vec_id "
    "WHERE contains(lower(d.text), 'on') ORDER BY id LIMIT 6",
)


@dataclass(frozen=True)
class _Recall:
    """A caller's recall model: every shortlist finds the given share."""

    share: float

    def expected(self, k: int, pool: int) -> float:
        return self.share


def _recall_model(spark: SparkSession, sf: str) -> DataFrame:
    found = []
    for name, share in (("finds all", 1.0), ("finds none", 0.0)):
        semantics = Semantics(KeywordVerifier(), FixedEmbedder(), minimum_shortlist=1, oversample=2, recall=_Recall(share))
        semantics.verifier.cost_hint = CostHint(per_candidate=1.0)
        db = connect(catalog(), {"lake": sf}, spark=spark, semantic=semantics)
        one = db.query({"from": {"dataset": "document"}, "where": MEANS, "page": {"first": 5}}).reports[0]
        found.append((name, one.plan, one.shortlisted))
    return rows(spark, "model string, plan string, shortlisted long", found)


CASES["semantic_recall_model"] = Case(
    _recall_model,
    f"WITH near AS (SELECT count(*) AS n FROM documents WHERE doc_id IN ({_NEAR_ALL.format(k=10)})) "
    "SELECT 'finds all' AS model, 'vector_shortlist' AS plan, n AS shortlisted FROM near UNION ALL "
    "SELECT 'finds none', CASE WHEN count(*) <= 1000 THEN 'verify_all' ELSE 'vector_shortlist' END, CASE WHEN count(*) > 1000 THEN max(n) END FROM documents, near",
)


def _fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Without an embedding provider a shortlist is not possible, and everything is verified."""
    db = connect(catalog(), {"lake": sf}, spark=spark, semantic=Semantics(KeywordVerifier(), maximum_candidates=None))
    where = {"all": [f("source", "eq", "src3"), MEANS]}
    found = db.query({"from": {"dataset": "document"}, "select": ["lang"], "where": where, "page": {"first": 500}})
    return found.dataframe.withColumn("plan", F.lit(found.reports[0].plan)).withColumn("exact", F.lit(found.exact))


CASES["semantic_fallback"] = Case(
    _fallback, f"SELECT id, lang, 'verify_all' AS plan, true AS exact FROM ({DOCUMENT}) WHERE {_HELD} ORDER BY id LIMIT 500"
)


def _report(spark: SparkSession, sf: str) -> DataFrame:
    """What a condition says of all its candidates, not only of those that fill the page."""
    where = {"all": [f("source", "eq", "src3"), MEANS]}
    semantics = Semantics(KeywordVerifier(), preference="verify_all", maximum_candidates=None, stop_at_page=False)
    found = connect(catalog(), {"lake": sf}, spark=spark, semantic=semantics).query({"from": {"dataset": "document"}, "where": where, "page": {"first": 500}})
    one = found.reports[0]
    return rows(
        spark,
        "plan string, exact boolean, considered long, verified long, qualified long, cost double",
        [(one.plan, one.exact, one.considered, one.verified, one.qualified, one.usage.cost)],
    )


_SRC3 = "SELECT count(*) FROM documents WHERE source = 'src3'"
_SRC3_ON = f"{_SRC3} AND contains(lower(text), 'on')"
CASES["semantic_report"] = Case(
    _report,
    f"SELECT 'verify_all' AS plan, true AS exact, ({_SRC3}) AS considered, ({_SRC3}) AS verified, ({_SRC3_ON}) AS qualified, CAST(({_SRC3}) AS DOUBLE) AS cost",
)


def _semantic_side(spark: SparkSession, sf: str) -> DataFrame:
    return _case_db(spark, sf, "verify_all").query(
        {
            "from": {"dataset": "case"},
            "select": [],
            "traverse": [{"relationship": "case_document", "as": "d", "select": ["lang"], "where": {"all": [f("source", "eq", "src3"), MEANS]}}],
            "page": {"first": 500},
        }
    ).dataframe


CASES["join_semantic_side"] = Case(
    _semantic_side,
    f'SELECT c.doc_id AS id, d.id AS "d.id", d.lang AS "d.lang" FROM labels c JOIN ({DOCUMENT}) d ON c.doc_id = d.id WHERE {_HELD.replace("source", "d.source").replace("body", "d.body")} ORDER BY 1, 2 LIMIT 500',
)

# --- refusals -----------------------------------------------------------------


def refusals(key: str, cases: list[tuple[str, dict, str, str | None]], **options) -> None:
    """Register queries that must be refused, each with its code and location."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = []
        for name, query, _, _ in cases:
            try:
                database(spark, sf, **options).query(query).rows
                found.append((name, "answered", None))
            except TarnError as error:
                found.append((name, error.code.value, error.detail.location))
        return rows(spark, "name string, code string, location string", found)

    CASES[key] = Case(run, values("name, code, location", [(n, c, at) for n, _, c, at in cases]))


def on(dataset: str, **more) -> dict:
    return {"from": {"dataset": dataset}} | more


def deep(levels: int) -> dict:
    node = f("status", "eq", "F")
    for _ in range(levels):
        node = {"not": node}
    return node


refusals(
    "err_shape",
    [
        ("unknown key", on("order", group_by=[]), "query_shape_invalid", "group_by"),
        ("no from", {"select": []}, "query_shape_invalid", "from"),
        ("unknown from key", {"from": {"dataset": "order", "x": 1}}, "query_shape_invalid", "from.x"),
        ("select not a list", on("order", select="id"), "query_shape_invalid", "select"),
        ("repeated order", on("order", order_by=[by("id"), by("id")]), "query_shape_invalid", "order_by[1].field"),
        ("two kinds", on("order", where={"all": [], "any": []}), "query_expression_invalid", "where"),
        ("empty all", on("order", where={"all": []}), "query_expression_invalid", "where.all"),
        ("offset", on("order", page={"first": 5, "offset": 5}), "query_shape_invalid", "page.offset"),
        ("unknown operator", on("order", where=f("id", "like", "1")), "query_operator_not_supported", "where.op"),
        ("unknown dataset", on("nobody"), "dataset_not_found", "from.dataset"),
    ],
)
refusals(
    "err_field",
    [
        ("select", on("order", select=["nothing"]), "field_not_found", "select[0]"),
        ("where", on("order", where={"all": [f("nothing", "eq", 1)]}), "field_not_found", "where.all[0].field"),
        ("order", on("order", order_by=[by("nothing")]), "field_not_found", "order_by[0].field"),
        ("internal", on("page", select=["html"]), "field_not_accessible", "select[0]"),
        ("internal filter", on("page", where=f("html", "contains", "x")), "field_not_accessible", "where.field"),
    ],
)
refusals(
    "err_value",
    [
        ("text for float", on("order", where=f("total", "gt", "1")), "query_value_type_invalid", "where.value"),
        ("naive time", on("order", where=f("ordered_at", "gt", "2024-01-01T00:00:00")), "query_value_type_invalid", "where.value"),
        ("bool for int", on("part", where=f("size", "eq", True)), "query_value_type_invalid", "where.value"),
        ("null", on("part", where={"field": "size", "op": "eq", "value": None}), "query_value_type_invalid", "where.value"),
        ("value for is_null", on("part", where={"field": "size", "op": "is_null", "value": 1}), "query_value_type_invalid", "where.value"),
        ("number for id", on("part", where=f("id", "eq", 7)), "query_value_type_invalid", "where.value"),
        ("nan", on("order", where=f("total", "eq", float("nan"))), "query_value_type_invalid", "where.value"),
        ("empty list", on("part", where=f("size", "in", [])), "query_value_type_invalid", "where.value"),
        ("bad item", on("part", where=f("size", "in", [1, "2"])), "query_value_type_invalid", "where.value[1]"),
        ("range of text", on("part", where=f("name", "gt", "a")), "query_operator_not_supported", "where.op"),
        ("json", on("event", where=f("props", "eq", "a")), "query_operator_not_supported", "where.op"),
        ("order json", on("event", order_by=[by("props")]), "query_operator_not_supported", "order_by[0].field"),
    ],
)
refusals(
    "err_limits",
    [
        ("page 0", on("order", page={"first": 0}), "query_limit_invalid", "page.first"),
        ("page 501", on("order", page={"first": 501}), "query_limit_invalid", "page.first"),
        ("long list", on("part", where=f("size", "in", list(range(1001)))), "query_limit_invalid", "where.value"),
        ("deep", on("order", where=deep(32)), "query_limit_invalid", "where" + ".not" * 32),
        ("wide", on("order", where={"any": [f("status", "eq", "F")] * 1000}), "query_limit_invalid", "where.any[999]"),
        ("results 501", on("order", constraints={"maximum_results": 501}), "query_limit_invalid", "constraints.maximum_results"),
    ],
)
refusals("err_quality_needs_semantic", [("none", on("document", constraints={"minimum_quality": 0.5}), "query_limit_invalid", "constraints.minimum_quality")], semantic="verify_all")
refusals("err_unclaimed_term", [("no provider", on("document", where=MEANS), "query_feature_not_supported", "where")])
refusals(
    "err_semantic",
    [
        ("inside any", on("document", where={"any": [MEANS]}), "query_feature_not_supported", "where.any[0]"),
        ("two", on("document", where={"all": [MEANS, MEANS]}), "query_feature_not_supported", "where"),
        ("field", on("document", where={"semantic": {"field": "lang", "proposition": "x"}}), "query_operator_not_supported", "where.semantic.field"),
        ("long", on("document", where={"semantic": {"field": "body", "proposition": "x" * 1001}}), "query_limit_invalid", "where.semantic.proposition"),
    ],
    semantic="verify_all",
)
refusals(
    "semantic_budgets",
    [("cost", on("document", where={"all": [f("source", "eq", "src3"), MEANS]}, constraints={"maximum_cost": 0.5}), "query_semantic_budget_exceeded", "constraints.maximum_cost")],
    semantic="verify_all",
)
_go = lambda **step: on("customer", traverse=[{"relationship": "customer_orders"} | step])
refusals(
    "err_relationship",
    [
        ("unknown", _go(relationship="nothing"), "relationship_not_found", "traverse[0].relationship"),
        ("from elsewhere", on("order", traverse=[{"relationship": "customer_orders"}]), "relationship_not_applicable", "traverse[0].relationship"),
        ("two steps", on("customer", traverse=[{}, {}]), "query_feature_not_supported", "traverse"),
        ("alias", _go(**{"as": "a.b"}), "query_shape_invalid", "traverse[0].as"),
        ("direction", _go(direction="up"), "query_shape_invalid", "traverse[0].direction"),
    ],
)
refusals(
    "err_location_prefix",
    [
        ("select", _go(select=["nothing"]), "field_not_found", "traverse[0].select[0]"),
        ("where", _go(where={"not": f("total", "gt", "x")}), "query_value_type_invalid", "traverse[0].where.not.value"),
    ],
)


def _timeout(spark: SparkSession, sf: str) -> DataFrame:
    try:
        database(spark, sf).query({"from": {"dataset": "order"}, "order_by": [by("total")]}, timeout_seconds=1e-6).rows
        code = "answered"
    except TarnError as error:
        code = error.code.value
    return rows(spark, "code string", [(code,)])


CASES["timeout"] = Case(_timeout, "SELECT 'query_timeout' AS code")


def _fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    db = database(spark, sf)
    a, b = f("status", "eq", "F"), f("total", "gt", 5)
    print_of = lambda **q: db.query(on("order", **q)).query_fingerprint
    base = print_of(where={"all": [a, b]}, select=["status", "total"])
    found = [
        ("member order", base == print_of(where={"all": [b, a]}, select=["total", "status"])),
        ("page size", base == print_of(where={"all": [a, b]}, select=["status", "total"], page={"first": 7})),
        ("values", base == print_of(where={"all": [a, f("total", "gt", 6)]}, select=["status", "total"])),
        ("plan ignores values", db.explain(on("order", where=b)).plan_fingerprint == db.explain(on("order", where=f("total", "gt", 9))).plan_fingerprint),
        ("catalog", catalog_fingerprint(db.catalog) == db.query(on("order")).catalog_fingerprint),
    ]
    return rows(spark, "name string, equal boolean", found)


CASES["fingerprints"] = Case(
    _fingerprints,
    "SELECT * FROM (VALUES ('member order', true), ('page size', true), ('values', false), ('plan ignores values', true), ('catalog', true)) t(name, \"equal\")",
)


def _capabilities(spark: SparkSession, sf: str) -> DataFrame:
    found = [(c.operator, c.kind, c.support) for c in capabilities() if c.kind in ("parquet", "postgres", "neo4j")]
    return rows(spark, "operator string, kind string, support string", found)


_DOES = {"parquet": "scan project filter", "postgres": "scan project filter key_lookup order limit top_k", "neo4j": ""}
_EVERY = "scan project filter key_lookup order limit top_k vector_search combine join semantic_verify"
CASES["capabilities"] = Case(
    _capabilities,
    values(
        "operator, kind, support",
        [(o, k, "none" if k == "neo4j" else "source" if o in done.split() else "engine") for k, done in _DOES.items() for o in _EVERY.split()]
        + [(o, k, "planned") for k in _DOES for o in ("aggregate", "group_by", "distinct", "union", "multi_hop")],
    ),
)


class _CountsOnly:
    """A provider that knows row counts, and fails for one source."""

    def rows(self, source: str, dataset: str) -> float | None:
        if source == "labels":
            raise OSError("no statistics")
        return 4000.0

    def field(self, source: str, dataset: str, name: str):
        return None


def _statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Expected records by measured figures and by a caller's provider, as explanations tell them."""
    asked = {
        "all": on("order"),
        "status": on("order", where=f("status", "eq", "O")),
        "total": on("order", where={"not": f("total", "is_null")}),
    }
    found = []
    for provider, statistics in (("measured", "measured"), ("own", _CountsOnly())):
        db = connect(catalog(), {"lake": sf}, spark=spark, statistics=statistics)
        for name, query in asked.items():
            found.append((provider, name, int(db.explain(query).notes[-1].rpartition(" ")[2])))
    return rows(spark, "provider string, name string, expected long", found)


CASES["statistics"] = Case(
    _statistics,
    "WITH o AS (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS d FROM orders) "
    "SELECT 'measured' AS provider, 'all' AS name, n AS expected FROM o UNION ALL SELECT 'measured', 'status', CAST(round(n / d) AS BIGINT) FROM o "
    "UNION ALL SELECT 'measured', 'total', n FROM o UNION ALL SELECT 'own', 'all', 4000 UNION ALL SELECT 'own', 'status', 200 UNION ALL SELECT 'own', 'total', 3920",
)


def _source_kind(spark: SparkSession, sf: str) -> DataFrame:
    """A caller's own kind of source: one table kept as a file a status, read as a whole."""
    register_reader("statuses", lambda session, resource, address: session.read.parquet(f"{address}/{resource}").where("o_orderstatus <> 'F'"))
    parts = documents({name: DATASETS[name] for name in ("customer", "order")})
    parts[1]["sources"]["orders"]["kind"] = "statuses"
    db = connect(build_catalog(*parts), {"lake": sf}, spark=spark)
    return db.query(on("order", select=["status"], where=f("total", "gt", 300000), page={"first": 500})).dataframe


CASES["source_kind"] = Case(
    _source_kind,
    "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 300000 ORDER BY id LIMIT 500",
)


def _custom_term(spark: SparkSession, sf: str) -> DataFrame:
    """A caller's own filter term, registered and used like the built-in ones."""
    register_term(
        Term(
            "between",
            lambda body, at: (body["field"], body["low"], body["high"]),
            lambda body, spec, at: frozenset({body[0]}),
            lambda body, column: column(body[0]).between(body[1], body[2]),
        )
    )
    where = {"all": [{"between": {"field": "length", "low": 500, "high": 900}}, {"not": {"between": {"field": "toxic", "low": 1, "high": 1}}}]}
    return database(spark, sf).query({"from": {"dataset": "document"}, "select": ["length"], "where": where, "page": {"first": 500}}).dataframe


CASES["custom_term"] = Case(
    _custom_term,
    f"SELECT id, length FROM ({DOCUMENT}) WHERE length BETWEEN 500 AND 900 AND NOT toxic BETWEEN 1 AND 1 ORDER BY id LIMIT 500",
)


def _explain(spark: SparkSession, sf: str) -> DataFrame:
    found = database(spark, sf).explain(on("document", select=["lang"], where={"all": [f("quality", "eq", 1), f("lang", "eq", "en")]}))
    return rows(spark, "kind string, location string", [(n.kind, n.location) for n in found.nodes])


CASES["explain"] = Case(
    _explain,
    values("kind, location", [("scan", "documents"), ("scan", "labels"), ("combine", "engine"), ("order_page", "engine"), ("project", "engine")]),
)


def queries() -> dict[str, Query]:
    return {key: case.run for key, case in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: case.sql for key, case in CASES.items() if case.sql}
