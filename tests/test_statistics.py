"""Expected sizes against counts on data that fits their assumptions, and without any figures."""

import math
from datetime import UTC, datetime

import pytest

from tarn.plans.request import Comparison, Group, Negation
from tarn.plans.statistics import FieldFigures, share

KNOWN = {
    "n": FieldFigures(distinct=100, null_share=0.0, least=0, most=100),
    "k": FieldFigures(distinct=4, null_share=0.2, common={"a": 0.5}),
    "t": FieldFigures(distinct=10, null_share=0.0, least=datetime(2024, 1, 1), most=datetime(2024, 1, 11)),
    "one": FieldFigures(distinct=1, null_share=0.0, least=7, most=7),
}


def c(field, operator, value=None):
    return Comparison(field, operator, value, "where")


@pytest.mark.parametrize(
    ("where", "wanted"),
    [
        (None, 1.0),
        (c("n", "eq", 5), 0.01),
        (c("n", "ne", 5), 0.99),
        (c("n", "eq", 500), 0.0),
        (c("n", "in", (5, 6, 6)), 0.02),
        (c("n", "lt", 25), 0.25),
        (c("n", "gte", 25), 0.75),
        (c("n", "gt", 1000), 0.0),
        (c("k", "eq", "a"), 0.4),
        (c("k", "eq", "b"), 0.8 * 0.5 / 3),
        (c("k", "is_null"), 0.2),
        (c("k", "is_not_null"), 0.8),
        (c("t", "lt", datetime(2024, 1, 6, tzinfo=UTC)), 0.5),
        (c("one", "gt", 7), 1.0),
        (c("x", "eq", 1), 0.05),
        (c("x", "lt", 1), 1 / 3),
        (c("x", "is_null"), 0.02),
        (c("x", "contains", "a"), 0.1),
        (Negation(c("n", "lt", 25), "where"), 0.75),
        (Group("all", (c("n", "lt", 50), c("t", "lt", datetime(2024, 1, 6))), "where"), 0.25),
        (Group("any", (c("n", "lt", 50), c("t", "lt", datetime(2024, 1, 6))), "where"), 0.75),
        (object(), 0.1),
    ],
)
def test_shares(where, wanted):
    assert math.isclose(share(where, lambda name: KNOWN.get(name, FieldFigures())), wanted, abs_tol=1e-12)
