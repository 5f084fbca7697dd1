"""Semantic queries over more candidates than the default limit of 1,000."""

import pytest

from oracle import compare, connection
from tarn.suite.queries import CASES
from test_suite import SF

TABLES = ("documents", "doc_id"), ("labels", "doc_id"), ("embeddings", "vec_id")


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """The smallest tables with 1,500 documents of source src3, ids shifted."""
    folder = str(tmp_path_factory.mktemp("many"))
    con = connection(SF)
    for table, key in TABLES:
        chosen = "WHERE source = 'src3'" if table == "documents" else f"WHERE {key} IN (SELECT doc_id FROM documents WHERE source = 'src3')"
        con.execute(
            f"COPY (SELECT t.* REPLACE (CAST(t.{key} + 100000 * k.range AS BIGINT) AS {key}) FROM (SELECT * FROM {table} {chosen}) t, "
            f"range((SELECT CAST(ceil(1500 / count(*)) AS BIGINT) FROM documents WHERE source = 'src3')) k) TO '{folder}/{table}.parquet' (FORMAT parquet)"
        )
    for table in "region nation customer supplier part orders lineitem events pages benchmark conversations".split():
        con.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("key", ["join_semantic_side", "semantic_min_quality", "semantic_term", "semantic_verify_with_filter", "semantic_verify_all", "semantic_fallback", "semantic_report"])
def test_every_candidate_counts(spark, many, key):
    con = connection(many)
    assert con.execute("SELECT count(*) FROM documents WHERE source = 'src3'").fetchone()[0] >= 1500
    assert compare(CASES[key].run(spark, many), CASES[key].sql, con)
