"""The registered queries of the classifiers and of SimHash, each against brute force on the smallest tables."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import test_classifiers  # noqa: E402
import test_dedup  # noqa: E402
import test_toxicity_blocks  # noqa: E402

from tarn.llm import fitting, language, quality, queries, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def remainder(number, modulus):
    return zlib.crc32(str(number).encode()) % modulus


def test_simhash(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = {d: test_dedup.brute_fingerprint(t) for d, t in rows}
    classes = test_dedup.brute_components(set(prints.values()), 4)
    least = {}
    for d, p in prints.items():
        least[classes[p]] = min(least.get(classes[p], d), d)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()}
    assert found == {d: (f"{p:016x}", least[classes[p]]) for d, p in prints.items()}


def test_toxicity(spark, docs, labels):
    model = toxicity.train_toxicity(docs, labels)
    found = {r.doc_id: r for r in queries.op2_toxicity(spark, SF).collect()}
    assert len(found) == docs.count()
    for d in docs.collect():
        r, score = found[d.doc_id], test_toxicity_blocks.brute(model, d.text)
        assert np.isclose(r.score, score, atol=1e-9) and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (remainder(d.doc_id, 3) == 1)


def whole_quality(field, text):
    """The score from the features and marginals of all lines at once (marginals are held to enumeration elsewhere)."""
    active = quality.text_features(text)
    if active is None:
        return fitting.sigmoid(field.out[1] + field.out[2])
    lengths = np.array([len(x) for x in quality.lines_of(text)])
    mean = (quality.marginals(field.unary(active), field.pairs)[:, quality.GOOD] * lengths).sum() / lengths.sum()
    return fitting.sigmoid(np.log((mean + 1e-4) / (1 - mean + 1e-4)) * field.out[0] + field.out[2])


def test_quality(spark, docs, labels):
    field = quality.train_quality(docs, labels)
    found = {r.doc_id: r for r in queries.op7_quality(spark, SF).collect()}
    assert len(found) == docs.count()
    for d in docs.collect():
        r = found[d.doc_id]
        assert np.isclose(r.score, whole_quality(field, d.text), atol=1e-9) and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (remainder(d.doc_id, 3) == 1)


def test_language(spark, docs):
    model = language.train_language(docs)
    found = {r.doc_id: r for r in queries.op9_language_id(spark, SF).collect()}
    assert len(found) == docs.count()
    checked = 0
    for d in docs.collect():
        r = found[d.doc_id]
        assert r.held_out == (remainder(d.doc_id, 5) == 0)
        if not any(map(str.isalpha, d.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif len(d.text) < 3000:
            chances = test_classifiers.brute_language(model, d.text)
            assert r.lang_pred == model.languages[int(chances.argmax())] and np.isclose(r.score, chances.max(), atol=1e-5)
            checked += 1
    assert checked > 50


def test_training_never_sees_held_out_labels(spark, docs, labels):
    """Turning every held-out label and language round changes no score."""
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(fitting.id_remainder("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train_toxicity(docs, labels), toxicity.train_toxicity(docs, turned)
    assert np.array_equal(a.scores, b.scores) and a.bias == b.bias
    wrong = docs.withColumn("lang", F.when(fitting.id_remainder("doc_id", 5) == 0, "zz").otherwise(F.col("lang")))
    assert language.train_language(wrong).languages == language.train_language(docs).languages
