"""Semantics on a small catalog full of nulls: random queries against SQL, assembly, links, refusals, plans."""

from __future__ import annotations

import json
import random

import duckdb
import pandas as pd
import pytest

from oracle import in_order
from tarn import Guards, Semantics, TarnError, Usage, Verdict, build_catalog, connect
from tarn.catalog import API_VERSION
from tarn.cli import main
from tarn.errors import CatalogError
from tarn.mcp_server import Tools
from tarn.render import jsonable, table

ACCOUNTS = pd.DataFrame(
    {
        "account": [f"c{k:02d}" for k in range(1, 13)],
        "name": ["Ada", "bob", None, "Cy", "Ada", "dee", "Eve", "éve", "Fox", None, "gus", "Hal"],
        "seats": pd.array([5, None, 3, 9, 5, 1, None, 7, 2, 2, 8, 0], dtype="Int64"),
        "joined": pd.to_datetime(["2024-01-01", None, "2024-02-01", "2023-05-05"] * 3),
        "vip": pd.array([True, False, None] * 4, dtype="boolean"),
        "boss": ["c02", "c02", None, "c99", "c01", "c01", None, "c03", "c03", "c04", "c05", "c12"],
    }
)
BILLING = pd.DataFrame(
    {
        "who": ["c01", "c02", "c03", "c05", "c06", "c07", "c08", "c10", "c11", "c20"],
        "plan": ["pro", None, "free", "pro", "free", "pro", "team", None, "free", "pro"],
        "fee": [10.5, None, 0.0, 99.0, 0.0, 10.5, -1.0, 3.25, None, 7.0],
    }
)
SUPPORT = pd.DataFrame({"who": ["c01", "c03", "c04", "c08", "c30"], "tier": ["gold", None, "tin", "gold", "gold"], "tickets": pd.array([3, 0, None, 1, 9], dtype="Int64")})
FIELDS = {
    "id": ("id", "crm", "account"), "name": ("string", "crm", "name"), "seats": ("int", "crm", "seats"),
    "joined": ("timestamp", "crm", "joined"), "vip": ("bool", "crm", "vip"), "boss": ("id", "crm", "boss"),
    "plan": ("string", "billing", "plan"), "fee": ("float", "billing", "fee"),
    "tier": ("string", "support", "tier"), "tickets": ("int", "support", "tickets"),
}
KEYS = {"crm": "account", "billing": "who", "support": "who"}
SQL = (
    "SELECT c.account AS id, c.name, c.seats, c.joined, c.vip, c.boss, b.plan, b.fee, s.tier, s.tickets FROM crm c "
    "LEFT JOIN billing b ON b.who = c.account LEFT JOIN support s ON s.who = c.account"
)


def parts():
    sources = {
        name: {
            "kind": "parquet", "connection_ref": "lake", "read_only": True,
            "datasets": {"customer": {"resource": f"{name}.parquet", "identity": ["id"], "fields": {"id": {"physical_name": key}} | {
                f: {"physical_name": c} for f, (_, s, c) in FIELDS.items() if s == name}}},
        }
        for name, key in KEYS.items()
    }
    fields = {f: {"type": kind, "description": f, "semantic_eligible": f == "name"} for f, (kind, _, _) in FIELDS.items()}
    end = lambda f: {"source": "crm", "field": f}
    relation = {"from": "customer", "to": "customer", "description": "d", "cardinality": "many_to_one"}
    return (
        {"api_version": API_VERSION, "catalog": {"name": "small", "version": 2}, "datasets": {"customer": {"description": "people", "fields": fields}}},
        {"api_version": API_VERSION, "sources": sources, "resolution": {"customer": {"identity_source": "crm", "field_sources": {f: s for f, (_, s, _) in FIELDS.items()}}}},
        {
            "api_version": API_VERSION,
            "relationships": {
                "boss": relation | {"direction": "bi", "aliases": ["manager"], "implementations": [{"from": end("boss"), "to": end("id")}]},
                "one_way": relation | {"direction": "uni", "implementations": [{"from": end("boss"), "to": end("id")}]},
                "edge": relation | {"direction": "bi", "implementations": [{"from": end("boss"), "to": end("id"), "edge_type": "E"}]},
            },
        },
    )


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    folder = tmp_path_factory.mktemp("lake")
    for name, frame in (("crm", ACCOUNTS), ("billing", BILLING), ("support", SUPPORT)):
        frame.to_parquet(folder / f"{name}.parquet", coerce_timestamps="us")
    return str(folder)


@pytest.fixture(scope="module")
def db(spark, lake):
    return connect(build_catalog(*parts()), {"lake": lake}, spark=spark)


@pytest.fixture(scope="module")
def con(lake):
    found = duckdb.connect()
    for name in KEYS:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{lake}/{name}.parquet')")
    found.execute(f"CREATE VIEW customer AS {SQL}")
    return found


def random_filter(rng, depth=0):
    """(query filter, SQL) of a random tree."""
    if depth < 3 and rng.random() < 0.5:
        kind = rng.choice(["all", "any", "not"])
        members = [random_filter(rng, depth + 1) for _ in range(1 if kind == "not" else rng.randint(1, 3))]
        if kind == "not":
            return {"not": members[0][0]}, f"(NOT {members[0][1]})"
        return {kind: [m for m, _ in members]}, "(" + {"all": " AND ", "any": " OR "}[kind].join(s for _, s in members) + ")"
    field = rng.choice([f for f in FIELDS])
    kind = FIELDS[field][0]
    quote = lambda v: str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else f"TIMESTAMP '{v[:19]}'" if kind == "timestamp" else f"'{v}'"
    pool = {
        "id": ["c01", "c03", "c12", "zz"], "string": ["pro", "Ada", "gold", "e"], "int": [0, 2, 5, 10**30], "float": [0.0, 10.5, 50],
        "bool": [True, False], "timestamp": ["2024-01-01T00:00:00+00:00", "2023-12-31T00:00:00Z"],
    }[kind]
    choices = ["eq", "ne", "in", "not_in", "is_null", "is_not_null"]
    choices += ["gt", "gte", "lt", "lte"] if kind in ("int", "float", "timestamp") else []
    choices += ["contains", "starts_with"] if kind == "string" else []
    op, value = rng.choice(choices), rng.choice(pool)
    if op in ("is_null", "is_not_null"):
        return {"field": field, "op": op}, f"({field} {op.replace('_', ' ').replace('is not', 'IS NOT')})"
    if op in ("in", "not_in"):
        chosen = rng.sample(pool, rng.randint(1, len(pool)))
        return {"field": field, "op": op, "value": chosen}, f"({field} {op.replace('_', ' ')} ({', '.join(map(quote, chosen))}))"
    if op in ("contains", "starts_with"):
        return {"field": field, "op": op, "value": value}, f"{op}({field}, {quote(value)})"
    sign = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[op]
    return {"field": field, "op": op, "value": value}, f"({field} {sign} {quote(value)})"


def test_random_queries_equal_sql_in_order(db, con):
    rng = random.Random(2024)
    found = 0
    for _ in range(120):
        where, sql = random_filter(rng)
        select = rng.sample(list(FIELDS), rng.randint(0, 6))
        order = rng.sample(list(FIELDS), rng.randint(0, 3))
        directions = [rng.choice(["asc", "desc"]) for _ in order]
        terms = [f"{f} {d} NULLS {'LAST' if d == 'asc' else 'FIRST'}" for f, d in zip(order, directions, strict=True)]
        first = rng.choice([1, 3, 100])
        query = {
            "from": {"dataset": "customer"}, "select": select, "where": where, "page": {"first": first},
            "order_by": [{"field": f, "direction": d} for f, d in zip(order, directions, strict=True)],
        }
        names = ["id", *[s for s in select if s != "id"]] if "id" not in select else select
        expected = con.execute(f"SELECT {', '.join(names)} FROM customer WHERE {sql} ORDER BY {', '.join([*terms, 'id'])} LIMIT {first}").fetchall()
        rows = db.query(query).rows
        assert in_order(names, [[r[n] for n in names] for r in rows]) == in_order(names, expected), (query, sql)
        found += len(rows)
    assert found > 200


@pytest.mark.parametrize("direction", ["forward", "reverse"])
def test_random_links_equal_sql(db, con, direction):
    rng = random.Random(7)
    on = "l.boss = r.id" if direction == "forward" else "l.id = r.boss"
    found = 0
    for _ in range(25):
        left, right = random_filter(rng), random_filter(rng)
        optional = rng.random() < 0.5
        query = {
            "from": {"dataset": "customer"}, "select": ["name"], "where": left[0], "page": {"first": 500},
            "order_by": [{"field": "m.fee", "direction": "desc"}],
            "traverse": [{"relationship": "manager", "as": "m", "select": ["tier"], "where": right[0], "optional": optional, "direction": direction}],
        }
        sql = (
            f"SELECT l.id, l.name, r.id AS rid, r.tier FROM (SELECT * FROM customer WHERE {left[1]}) l {'LEFT ' if optional else ''}JOIN "
            f"(SELECT * FROM customer WHERE {right[1]}) r ON {on} ORDER BY r.fee DESC NULLS FIRST, l.id, r.id NULLS LAST"
        )
        rows = db.query(query).rows
        names = ["id", "name", "m.id", "m.tier"]
        assert in_order(list("abcd"), [[r[n] for n in names] for r in rows]) == in_order(list("abcd"), con.execute(sql).fetchall()), (query, sql)
        found += len(rows)
    assert found > 20


def test_sources_without_used_fields_are_not_read(db):
    plan = db.query({"from": {"dataset": "customer"}, "select": ["name"]}).dataframe._jdf.queryExecution().toString()
    assert "crm.parquet" in plan and "billing" not in plan and "Join" not in plan


def test_required_contributor_becomes_an_inner_join_with_pushed_filter(db):
    where = {"field": "plan", "op": "eq", "value": "pro"}
    plan = db.query({"from": {"dataset": "customer"}, "select": ["plan"], "where": where}).dataframe._jdf.queryExecution().executedPlan().toString()
    assert "Inner" in plan and "EqualTo(plan,pro)" in plan and "LeftOuter" not in plan
    where = {"field": "plan", "op": "is_null"}
    assert "LeftOuter" in db.query({"from": {"dataset": "customer"}, "where": where}).dataframe._jdf.queryExecution().executedPlan().toString()


def code_of(call):
    with pytest.raises(TarnError) as error:
        call()
    return error.value.code.value, error.value.detail.location


def step(**more):
    return {"from": {"dataset": "customer"}, "traverse": [{"relationship": "boss"} | more]}


def test_link_refusals(db):
    assert code_of(lambda: db.query(step(relationship="edge")))[0] == "query_feature_not_supported"
    assert code_of(lambda: db.query(step(relationship="one_way", direction="reverse"))) == ("relationship_not_applicable", "traverse[0].relationship")
    assert code_of(lambda: db.query("{"))[0] == "query_shape_invalid"


@pytest.mark.parametrize("place", ["api", "unknown", "no id", "owner", "relation type", "no relations", "identifier"])
def test_bad_catalogs_are_refused(place):
    datasets, sources, relations = parts()
    if place == "api":
        datasets["api_version"] = "other"
    elif place == "unknown":
        sources["sources"]["crm"]["extra"] = 1
    elif place == "no id":
        del datasets["datasets"]["customer"]["fields"]["id"]
    elif place == "owner":
        sources["resolution"]["customer"]["field_sources"]["name"] = "billing"
    elif place == "relation type":
        relations["relationships"]["boss"]["implementations"][0]["to"]["field"] = "name"
    elif place == "no relations":
        relations["relationships"] = {}
    else:
        sources["sources"]["Bad-Name"] = sources["sources"]["crm"]
    with pytest.raises(CatalogError):
        build_catalog(datasets, sources, relations)


def test_a_rejected_refresh_keeps_the_active_catalog(spark, lake, tmp_path):
    import yaml

    names = ("datasets.yaml", "sources.yaml", "relations.yaml")
    write = lambda documents: [(tmp_path / n).write_text(yaml.safe_dump(d)) for n, d in zip(names, documents, strict=True)]
    write(parts())
    db = connect(tmp_path, {"lake": lake}, spark=spark)
    broken = parts()
    broken[1]["sources"]["billing"]["datasets"]["customer"]["fields"]["plan"]["physical_name"] = "gone"
    write(broken)
    result = db.refresh()
    assert result.outcome == "rejected" and [f.code for f in result.findings] == ["field_not_found"]
    (tmp_path / "sources.yaml").write_text(": [")
    assert db.refresh().outcome == "load_failed"
    assert len(db.query({"from": {"dataset": "customer"}}).rows) == 12
    write(broken)
    with pytest.raises(TarnError) as error:
        connect(tmp_path, {"lake": lake}, spark=spark)
    assert error.value.code == "source_validation_failed" and "gone" not in json.dumps(error.value.detail.as_dict(), default=str)
    write(parts())
    assert db.refresh().outcome == "activated"
    args = ["--catalog", str(tmp_path), "--connection", f"lake={lake}"]
    assert main(["query", *args, '{"from": {"dataset": "customer"}}', "--format", "jsonl"]) == 0
    assert main(["explain", *args, '{"from": {"dataset": "customer"}}', "--json"]) == 0
    assert main(["validate", *args]) == 0 and main(["catalog", "--catalog", str(tmp_path)]) == 0
    assert main(["query", *args, '{"from": {"dataset": "nobody"}}']) == 1
    assert main(["validate", "--catalog", str(tmp_path), "--connection", "other=x"]) == 3
    assert main(["query"]) == 2


class Judge:
    model, maximum_batch = "judge", 2

    def __init__(self, fail=False, partial=False):
        self.seen, self.fail, self.partial = [], fail, partial

    def verify(self, proposition, candidates, timeout):
        if self.fail:
            raise RuntimeError("down")
        self.seen += [c.id for c in candidates]
        verdicts = [Verdict(c.id, "e" in c.text.lower(), None if c.id == "c06" else 0.6) for c in candidates]
        return verdicts[1:] if self.partial else verdicts, Usage(calls=1, cost=1.0)


def semantic(spark, lake, judge, **options):
    return connect(build_catalog(*parts()), {"lake": lake}, spark=spark, semantic=Semantics(judge, **options))


ASK = {"from": {"dataset": "customer"}, "where": {"semantic": {"field": "name", "proposition": "has an e"}}, "order_by": [{"field": "id", "direction": "desc"}]}


def test_verification_stops_when_the_page_is_full(spark, lake):
    judge = Judge()
    found = semantic(spark, lake, judge).query(ASK | {"page": {"first": 1}})
    assert [r["id"] for r in found.rows] == ["c08"] and found.exact
    assert judge.seen == ["c12", "c11", "c09", "c08"] and found.reports[0].verified == 4


def test_quality_and_failures(spark, lake):
    asked = ASK | {"constraints": {"minimum_quality": 0.9}}
    assert [r["id"] for r in semantic(spark, lake, Judge()).query(asked).rows] == ["c06"]
    assert code_of(lambda: semantic(spark, lake, Judge(fail=True)).query(ASK))[0] == "semantic_provider_failed"
    assert code_of(lambda: semantic(spark, lake, Judge(partial=True)).query(ASK))[0] == "semantic_provider_failed"
    assert code_of(lambda: semantic(spark, lake, Judge(), maximum_candidates=5).query(ASK))[0] == "query_semantic_budget_exceeded"
    assert code_of(lambda: semantic(spark, lake, Judge(), preference="vector_shortlist").query(ASK))[0] == "query_plan_unsupported"
    assert len(semantic(spark, lake, Judge(), maximum_candidates=12).query(ASK).rows) == 3


def test_guards_and_tools(spark, lake, db):
    small = connect(build_catalog(*parts()), {"lake": lake}, spark=spark, guards=Guards(joined_rows=3))
    assert code_of(lambda: small.query(step()).rows)[0] == "query_coordinator_limit_exceeded"
    tools = Tools(db)
    assert tools.query({"from": {"dataset": "customer"}, "page": {"first": 2}})["note"]
    assert tools.query({"from": {"dataset": "x"}})["error"]["code"] == "dataset_not_found"
    assert tools.describe_catalog()["datasets"]["customer"]["fields"]["fee"] == {"type": "float"}
    assert [n["kind"] for n in tools.explain(ASK | {"where": {"field": "tier", "op": "eq", "value": "gold"}})["nodes"]][-1] == "project"
    assert "crm.parquet" not in json.dumps(tools.explain({"from": {"dataset": "customer"}}))


def spoiled(tmp_path, crm=ACCOUNTS, billing=BILLING):
    for name, frame in (("crm", crm), ("billing", billing), ("support", SUPPORT)):
        frame.to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
    return {"lake": str(tmp_path)}


def test_repeated_or_missing_ids_of_a_source_are_refused(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    twice = spoiled(tmp_path / "a", billing=pd.concat([BILLING, BILLING[:1]]))
    empty = spoiled(tmp_path / "b", crm=ACCOUNTS.assign(account=[None, *ACCOUNTS.account[1:]]))
    asked = {"from": {"dataset": "customer"}, "select": ["plan"]}
    for lake in (twice, empty):
        db = connect(build_catalog(*parts()), lake, spark=spark)
        with pytest.raises(TarnError) as error:
            db.query(asked)
        assert error.value.code == "query_plan_invariant_violation" and error.value.detail.source_name in ("billing", "crm")
        with pytest.raises(TarnError) as error:
            connect(build_catalog(*parts()), lake, spark=spark, check_ids=True)
        assert error.value.code == "source_validation_failed"
    db = connect(build_catalog(*parts()), twice, spark=spark)
    assert len(db.query({"from": {"dataset": "customer"}, "select": ["tier"]}).rows) == 12  # billing takes no part
    assert db.status()["ids"] == {"crm": 1, "billing": 0, "support": 1}
    trusting = connect(build_catalog(*parts()), twice, spark=spark, guards=Guards(trusted_ids=True))
    found = trusting.query(asked)
    assert trusting.status()["ids"] == {"crm": 0, "billing": 0, "support": 0}
    assert code_of(lambda: found.rows)[0] == "query_plan_invariant_violation"  # a page that holds one is refused


def test_descriptions_hide_internal_fields_and_sources(db):
    about = db.describe()
    assert about["customer"]["fields"]["name"] == {"type": "string", "semantic": True}
    assert set(about["customer"]["relationships"]) == {"boss", "one_way", "edge"}
    told = json.dumps(about) + json.dumps(db.status())
    assert "physical" not in told and "account" not in told and "parquet" not in told


def test_explanations_tell_of_catalyst_and_of_late_sources(db):
    query = {"from": {"dataset": "customer"}, "select": ["plan", "tier"], "where": {"field": "plan", "op": "eq", "value": "pro"}}
    found = db.explain(query)
    combine = next(n for n in found.nodes if n.kind == "combine")
    assert combine.detail == ("left billing", "left support, on the page only")
    (note,) = found.notes
    assert note.startswith("catalyst: ") and "2 BroadcastHashJoin" in note and "3 FileScan" in note
    assert "crm" not in note and "'pro'" not in note


def test_tools_are_registered_as_read_only(db, monkeypatch):
    """The protocol's package is optional: a stand-in records what it is given."""
    import sys
    import types

    from tarn import mcp_server

    given = {}

    class FastMCP:
        def __init__(self, name):
            given["name"] = name

        def add_tool(self, tool, annotations):
            given[tool.__name__] = annotations.readOnlyHint, tool

        def run(self):
            given["ran"] = True

    fast, kinds = types.ModuleType("mcp.server.fastmcp"), types.ModuleType("mcp.types")
    fast.FastMCP, kinds.ToolAnnotations = FastMCP, lambda readOnlyHint: types.SimpleNamespace(readOnlyHint=readOnlyHint)
    for name, module in (("mcp", types.ModuleType("mcp")), ("mcp.server", types.ModuleType("mcp.server")), ("mcp.server.fastmcp", fast), ("mcp.types", kinds)):
        monkeypatch.setitem(sys.modules, name, module)
    mcp_server.serve(db)
    assert given["name"] == "tarn" and given["ran"]
    for name in ("describe_catalog", "query", "explain"):
        assert given[name][0] is True
    answer = given["query"][1]({"from": {"dataset": "customer"}, "select": ["name"], "page": {"first": 1}})
    assert answer["rows"] == [{"id": "c01", "name": "Ada"}] and "full" in answer["note"]


def test_rendering():
    assert jsonable({"a": float("nan"), "b": b"\x00", "c": [1, None]}) == {"a": None, "b": "AA==", "c": [1, None]}
    assert table([{"id": 1, "x": None}]).splitlines()[0].split() == ["id", "x"] and table([]) == "(no rows)"
