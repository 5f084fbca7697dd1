"""Null join keys over whole tables."""

from tarn.suite.queries import CASES


def test_every_document_meets_null_keys(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").count()
    found = CASES["join_null_keys"].run(spark, tiny).collect()
    labelled = spark.read.parquet(f"{tiny}/labels.parquet").where("toxic IS NOT NULL").count()
    assert len(found) == docs and len({r.id for r in found}) == docs
    assert 0 < sum(r.other_id is not None for r in found) <= labelled < docs
