"""Filter terms that callers add to the query language."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column

from tarn.catalog import Dataset
from tarn.errors import refuse


@dataclass(frozen=True)
class Term:
    """A term ``{key: body}``.

    ``read`` checks the body's shape and returns what to keep of it; ``bind``
    checks it against a dataset and returns the names of the public fields it
    uses; ``column`` is the condition, over a function from field to column.
    Conditions follow three-valued logic like any other: null is unknown.
    """

    key: str
    read: Callable[[Any, str], Any]
    bind: Callable[[Any, Dataset, str], frozenset[str]]
    column: Callable[[Any, Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Custom:
    """A term in a filter tree; ``fields`` is known once it is bound."""

    key: str
    body: Any
    at: str
    fields: frozenset[str] = frozenset()


RESERVED = {"all", "any", "not", "semantic", "field", "op", "value"}
TERMS: dict[str, Term] = {}


def register_term(term: Term) -> None:
    if term.key in RESERVED:
        refuse("query_expression_invalid", f"'{term.key}' is part of the query language.", "where")
    TERMS[term.key] = term
