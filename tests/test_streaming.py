import pytest

from tarn import TarnError
from tarn.streaming.filtering import stream_records
from tarn.suite.tables import database

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    db = database(spark, SF)
    folder = tmp_path / "in"
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(str(folder))
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = {"from": {"dataset": "document"}, "select": ["lang", "toxic"], "where": {"any": [{"field": "toxic", "op": "eq", "value": 1}, {"field": "lang", "op": "eq", "value": "fr"}]}}
    out = stream_records(db, stream, query).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    out.awaitTermination()
    got = sorted(map(tuple, spark.table("found").collect()), key=str)
    batch = db.query(query | {"page": {"first": 500}}).dataframe
    assert got == sorted(map(tuple, batch.collect()), key=str) and got
    with pytest.raises(TarnError):
        stream_records(db, stream, query | {"order_by": [{"field": "id", "direction": "asc"}]})
