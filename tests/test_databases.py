"""Sources in databases, read over JDBC from the embedded one that comes with Spark."""

from __future__ import annotations

import pandas as pd
import pytest

from tarn import TarnError, build_catalog, connect
from tarn.catalog import API_VERSION
from tarn.sources import readers

URL = "jdbc:derby:memory:shop"
DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"
ROWS = pd.DataFrame({"ID": range(1, 41), "KIND": [f"k{n % 3}" for n in range(40)], "FEE": [n / 4 for n in range(40)]})


def parts(resource="ITEMS", kind="jdbc"):
    fields = {"id": ("id", "ID"), "kind": ("string", "KIND"), "fee": ("float", "FEE")}
    held = {"resource": resource, "identity": ["id"], "fields": {f: {"physical_name": c} for f, (_, c) in fields.items()}}
    source = {"kind": kind, "connection_ref": "shop", "read_only": True, "datasets": {"item": held}}
    end = {"source": "shop", "field": "kind"}
    return (
        {"api_version": API_VERSION, "catalog": {"name": "shop", "version": 1}, "datasets": {"item": {"description": "items", "fields": {f: {"type": t, "description": f} for f, (t, _) in fields.items()}}}},
        {"api_version": API_VERSION, "sources": {"shop": source}, "resolution": {"item": {"identity_source": "shop", "field_sources": dict.fromkeys(fields, "shop")}}},
        {"api_version": API_VERSION, "relationships": {"same": {"from": "item", "to": "item", "description": "d", "cardinality": "many_to_many", "direction": "bi", "implementations": [{"from": end, "to": end}]}}},
    )


@pytest.fixture(scope="module")
def shop(spark):
    spark.createDataFrame(ROWS).coalesce(1).write.jdbc(f"{URL};create=true", "ITEMS", "overwrite", {"driver": DRIVER, "createTableColumnTypes": "KIND VARCHAR(20)"})
    return {"shop": {"url": URL, "driver": DRIVER, "fetchsize": "7"}}


def test_queries_over_jdbc(spark, shop):
    db = connect(build_catalog(*parts()), shop, spark=spark)
    asked = {"from": {"dataset": "item"}, "select": ["fee"], "where": {"field": "kind", "op": "eq", "value": "k1"}, "order_by": [{"field": "fee", "direction": "desc"}]}
    found = db.query(asked)
    wanted = ROWS[ROWS.KIND == "k1"].sort_values("FEE", ascending=False)
    assert [(r["id"], r["fee"]) for r in found.rows] == list(zip(wanted.ID, wanted.FEE, strict=True))
    plan = found.dataframe._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(KIND,k1)" in plan and "ReadSchema: struct<ID:bigint,FEE:double>" in plan
    assert db.status()["ids"] == {"shop": 1}


@pytest.mark.parametrize(
    ("address", "resource", "code"),
    [
        ({"url": "jdbc:derby:memory:nowhere", "driver": DRIVER}, "ITEMS", "source_unavailable"),
        ({"url": URL, "driver": DRIVER}, "NOTHING", "resource_not_found"),
        ({"url": "jdbc:none:x"}, "ITEMS", "source_unavailable"),
    ],
)
def test_failures_have_codes(spark, shop, address, resource, code):
    with pytest.raises(TarnError) as error:
        connect(build_catalog(*parts(resource)), {"shop": address}, spark=spark)
    assert error.value.code == "source_validation_failed"
    assert [f["code"] for f in error.value.detail.details["findings"]["shop"]] == [code]
    assert "derby" not in str(error.value.detail.as_dict())


def test_a_source_that_goes_away_fails_with_a_code(spark, shop):
    spark.createDataFrame(ROWS[:5]).coalesce(1).write.jdbc("jdbc:derby:memory:gone;create=true", "ITEMS", "overwrite", {"driver": DRIVER, "createTableColumnTypes": "KIND VARCHAR(20)"})
    db = connect(build_catalog(*parts()), {"shop": {"url": "jdbc:derby:memory:gone", "driver": DRIVER}}, spark=spark)
    assert len(db.query({"from": {"dataset": "item"}}).rows) == 5
    with pytest.raises(Exception, match="gone"):  # dropping reports itself as an error
        spark.read.jdbc("jdbc:derby:memory:gone;drop=true", "ITEMS", properties={"driver": DRIVER})
    with pytest.raises(TarnError) as error:
        _ = db.query({"from": {"dataset": "item"}}).rows
    assert error.value.code in ("source_unavailable", "query_execution_failed")


class Thrown:
    def __init__(self, state, cause=None):
        self.state, self.cause = state, cause

    def getSQLState(self):
        return self.state

    def getCause(self):
        return self.cause


@pytest.mark.parametrize(
    ("state", "code"),
    [("28P01", "source_authentication_failed"), ("42501", "source_permission_denied"), ("08006", "source_unavailable"), ("57P01", "source_unavailable"), ("42P01", None), (None, None)],
)
def test_states_have_codes(state, code):
    error = RuntimeError()
    error.java_exception = Thrown(None, Thrown(state))
    assert readers.database_error(error) == code
    assert readers.database_error(RuntimeError()) is None


def test_postgres_sessions_are_read_only_and_utc(spark, monkeypatch):
    given = {}

    class Reader:
        def format(self, kind):
            given["format"] = kind
            return self

        def options(self, **options):
            given.update(options)
            return self

        def load(self):
            return "frame"

    class Session:
        read = Reader()

    assert readers.open_resource(Session(), "postgres", "crm.accounts", {"url": "jdbc:postgresql://h/d", "queryTimeout": "9"}) == "frame"
    assert given["format"] == "jdbc" and given["dbtable"] == "crm.accounts" and given["queryTimeout"] == "9"
    assert "READ ONLY" in given["sessionInitStatement"] and "'UTC'" in given["sessionInitStatement"]
    assert given["pushDownPredicate"] == "true" and given["driver"] == "org.postgresql.Driver"
