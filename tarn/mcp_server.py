"""Model Context Protocol tools over an open catalog; the protocol package is optional."""

from __future__ import annotations

from typing import Any

from tarn.client import Database
from tarn.errors import TarnError
from tarn.render import jsonable

GUIDE = (
    "Ask with one JSON object: from{dataset}, select[], where, order_by[{field,direction}], page{first}, "
    "constraints{}, traverse[{relationship,as,select,where,optional,direction}]. A filter is {field,op,value}, "
    "{all:[]}, {any:[]}, {not:{}} or {semantic:{field,proposition}}."
)


class Tools:
    """The three tools as plain functions; every refusal is returned as its detail."""

    def __init__(self, db: Database):
        self.db = db

    def describe_catalog(self) -> dict[str, Any]:
        return {"datasets": self.db.describe(), "guide": GUIDE, "limits": self.db.limits}

    def query(self, query: dict[str, Any]) -> dict[str, Any]:
        try:
            found = self.db.query(query)
            rows = jsonable(list(found.rows))
        except TarnError as error:
            return {"error": jsonable(error.detail.as_dict())}
        note = {"note": "The page is full; there may be more records."} if len(rows) >= found.page_size else {}
        semantic = {"semantic": {"exact": found.exact, "reports": [jsonable(r) for r in found.reports.values()]}} if found.reports else {}
        return {"rows": rows, "query_fingerprint": found.query_fingerprint, **note, **semantic}

    def explain(self, query: dict[str, Any]) -> dict[str, Any]:
        try:
            return jsonable(self.db.explain(query))
        except TarnError as error:
            return {"error": jsonable(error.detail.as_dict())}


def serve(db: Database) -> None:
    from mcp.server.fastmcp import FastMCP
    from mcp.types import ToolAnnotations

    server, tools = FastMCP("tarn"), Tools(db)
    for tool in (tools.describe_catalog, tools.query, tools.explain):
        server.add_tool(tool, annotations=ToolAnnotations(readOnlyHint=True))
    server.run()
