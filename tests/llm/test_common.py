import os

import pytest
from pyspark.sql import functions as F

from tarn.llm import common
from tarn.llm.common import Workspace, addressed, join_groups, picked


def test_workspace_leaves_no_tables(spark):
    with Workspace(spark) as ws:
        frame = ws.table(spark.range(10))
        root = ws.root.removeprefix("file:")
        assert frame.count() == 10 and os.path.isdir(root)
        kept = ws.deliver(frame.where("id > 6"))
    assert not os.path.exists(root) and kept.count() == 3


def test_addresses_do_not_depend_on_splits(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(3).write.parquet(path)
    read = lambda: {r["row"]: r.id for r in addressed(spark.read.parquet(path)).pick(id="id").collect()}
    before = read()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        after = read()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert before == after and len(before) == 1000
    rows = addressed(spark.read.parquet(path))
    few = rows.pick(id="id").where(F.col("id") % 100 == 0).select("row")
    assert sorted(r.id for r in rows.keep(few).collect()) == list(range(0, 1000, 100))


def test_frames_that_are_not_files_get_addresses(spark):
    frame = addressed(spark.range(100).withColumn("x", F.rand())).frame
    assert frame.select("row").distinct().count() == 100
    assert frame.exceptAll(frame).count() == 0


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a", "b", 2, 3)], "row long, text string, TEXT string, __row int, c0 int")
    assert picked(docs, text="text").first().text == "a" and picked(docs, text="TEXT").first().text == "b"
    assert picked(docs, text="Text").first().text == "a"
    rows = addressed(docs)
    kept = rows.keep(rows.frame)
    assert kept.columns == docs.columns and kept.collect() == docs.collect()
    with pytest.raises(ValueError, match="no column"):
        picked(docs, text="body")


@pytest.mark.parametrize("heavy", [2, 1 << 14])
def test_join_groups(spark, heavy, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", heavy)
    rows = spark.range(200).select(F.col("id"), F.when(F.col("id") < 120, 0).otherwise(F.col("id") % 7).alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("key <> 3")
    found = join_groups(rows, groups, "key", "n", 200)
    assert sorted(found.collect()) == sorted(rows.join(groups, "key").select(*found.columns).collect())
    assert common.join_groups(rows.limit(0), groups, "key", "n", 0).count() == 0
