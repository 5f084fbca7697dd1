"""The pipeline on the smallest tables against its stages done by brute force on whole lists."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import test_decontaminate  # noqa: E402
import test_dedup  # noqa: E402
import test_near  # noqa: E402

import corpus_pipeline  # noqa: E402
from tarn.llm import packing  # noqa: E402
from tarn.llm.language import UNKNOWN, train_language  # noqa: E402
from tarn.llm.queries import tokenizer_path  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute(rows, model, items):
    """(doc_id, text) rows that the filtering stages keep."""
    named = [(d, t) for d, t in rows if (p := model.predict(t))[0] != UNKNOWN and p[1] >= 0.3]
    best = {}
    for d, t in named:
        best[test_dedup.lower(t)] = max(best.get(test_dedup.lower(t), d), d)
    single = [(d, t) for d, t in named if best[test_dedup.lower(t)] == d]
    near = test_near.brute_rows(single)
    hits = {d: (n, h) for d, n, h, _ in test_decontaminate.brute(near, items)}
    return [(d, t) for d, t in near if hits[d][1] == 0 or 20 * hits[d][1] < hits[d][0]]


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = brute(rows, train_language(docs), items)
    found = corpus_pipeline.run(spark, SF).collect()
    tokens = {r.doc_id: r.doc_tokens for r in found}
    assert tokens == {d: len(packing.encode(tokenizer_path(), t, 0)) for d, t in kept}
    assert 0 < len(kept) < len(rows)
    assert sum(r.length for r in found) == sum(tokens.values())


def test_stages_keep_columns_and_bear_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "12 %", None, "s", 4)]
    odd += [(k, f"the quick brown fox number {k} jumps", "en", "s", 9) for k in range(3, 9)] + [(8, "der Hund und die Katze " * 400, "de", "s", 1)]
    folder = str(tmp_path)
    spark.createDataFrame(odd, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        assert kept.exceptAll(docs).count() == 0
    assert corpus_pipeline.run(spark, folder).agg(F.countDistinct("doc_id")).first()[0] > 0
    spark.createDataFrame([], schema).write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_names(name):
    assert name and len(corpus_pipeline.STAGES) == 5
