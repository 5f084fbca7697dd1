"""Connection references: names in the catalog, addresses outside of it."""

from __future__ import annotations

import os
from collections.abc import Mapping

from tarn.errors import SourceError

PREFIX = "TARN_CONN_"


class Connections:
    """Resolves a ``connection_ref`` from a mapping, or from ``TARN_CONN_<REF>`` in the environment.

    An address is a folder for file sources, a catalog or database name (may be
    empty) for tables, and a JDBC url, or a mapping of JDBC options, for databases.
    """

    def __init__(self, given: Mapping[str, object] | None = None):
        self.given = given

    def resolve(self, reference: str) -> object:
        if self.given is not None:
            if reference in self.given:
                return self.given[reference]
        elif (name := PREFIX + reference.upper()) in os.environ:
            return os.environ[name]
        raise SourceError(
            "connection_reference_not_found", f"Nothing is known about the connection reference '{reference}'."
        )
