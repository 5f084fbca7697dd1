"""Shortlists rank the whole store."""

import pytest

from tarn.suite.queries import CASES


@pytest.mark.parametrize("key", ["semantic_shortlist_all", "semantic_store_shortlist_all"])
def test_shortlist_takes_more_than_one_source(spark, tiny, key):
    found = [r.id for r in CASES[key].run(spark, tiny).collect()]
    sources = spark.read.parquet(f"{tiny}/documents.parquet").where(f"doc_id IN ({', '.join(map(str, found))})")
    assert found and sources.where("source <> 'src3'").count()
