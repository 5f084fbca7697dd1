import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import fitting, language, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(None, None, 1), (1, "", 1), (2, "   \n ", 1), (3, "12 34 %%", 1), (3, "12 34 %%", 1), (4, "word " * 200_000, 1), (6, "x" * 1_500_000, 1), (7, "ab\n" * 100_000, 1), (5, "あ́", 2)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score int")


def test_language_held_out_accuracy(spark):
    found = queries.op9_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert found.count() == docs.count()


@pytest.mark.parametrize(("query", "label", "least"), [("op2_toxicity", "toxic", 0.88), ("op7_quality", "quality", 0.9)])
def test_classifier_held_out_accuracy(spark, query, label, least):
    found = queries.QUERIES[query](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").select(label, "predicted", "score").collect()
    assert len(rows) > 60 and sum(r[0] == r.predicted for r in rows) / len(rows) > least
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_odd_rows(spark, odd):
    model = language.fit_language([("the quick brown fox", "en"), ("der schnelle braune Fuchs", "de")] * 20)
    found = language.identify_language(odd, model).collect()
    assert len(found) == len(ODD)
    assert [r.lang_pred for r in found if r.doc_id in (None, 1, 2, 3)] == ["und"] * 5
    assert language.identify_language(odd.limit(0), model).count() == 0
    empty = language.fit_language([])
    assert {r.lang_pred for r in language.identify_language(odd, empty).collect()} == {"und"}
    for trained in (toxicity.fit_toxicity([]), quality.fit_quality([]), quality.fit_quality([("x", 1)])):
        scores = [r.score for r in toxicity.score_texts(odd, trained).collect()]
        assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)


def test_blocks_count_like_whole_texts(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["Haus", "été", "dog", "x1"]) for _ in range(3000))
    whole = list(fitting.char_blocks(text, 1 << 20, 2))
    assert whole == [text]
    pieces = list(fitting.char_blocks(text, 100, 2))
    assert pieces[0] + "".join(p[2:] for p in pieces[1:]) == text
    counts = language.ngram_counts(text)
    monkeypatch.setattr(language, "char_blocks", lambda t, size, overlap: fitting.char_blocks(t, 100, overlap))
    assert (language.ngram_counts(text) == counts).all()


def test_subwords_equal_a_plain_count():
    text = "The idiots, été a go".lower()
    buckets, owners, words = toxicity.subwords(text.encode())
    assert words == 5
    spelled = [f" {w} ".encode() for w in ("the", "idiots", "été", "a", "go")]
    expected = [sum(max(0, len(w) - n + 1) for n in toxicity.ORDERS) for w in spelled]
    assert np.bincount(owners, minlength=5).tolist() == expected
    again, _, _ = toxicity.subwords(b"idiots")
    assert sorted(again.tolist()) == sorted(buckets[owners == 1].tolist())


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    unary, pairs = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
    chance = np.zeros((6, 2))
    both = np.zeros((2, 2))
    total = 0.0
    for code in range(64):
        y = [code >> k & 1 for k in range(6)]
        p = np.exp(sum(unary[k, y[k]] for k in range(6)) + sum(pairs[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        for k in range(6):
            chance[k, y[k]] += p
        for a, b in zip(y, y[1:], strict=False):
            both[a, b] += p
    assert np.allclose(quality.marginals(unary, pairs), chance / total)
    assert np.allclose(quality.pair_marginals(unary, pairs), both / total)


def brute_quality(field, text):
    """The score of a text by listing every labelling of its lines."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return fitting.sigmoid(field.out[1] + field.out[2])
    raw = [x.encode() for x in lines]
    own = quality.own_features(raw, np.array([lines[:k].count(x) for k, x in enumerate(lines)]))
    unary = field.unary(quality.neighbour_features(own))
    total, good = 0.0, np.zeros(len(lines))
    for y in itertools.product((0, 1), repeat=len(lines)):
        p = np.exp(sum(unary[k, v] for k, v in enumerate(y)) + sum(field.pairs[a, b] for a, b in itertools.pairwise(y)))
        total += p
        good += p * np.array(y)
    lengths = np.array([len(x) for x in raw])
    mean = (good / total * lengths).sum() / lengths.sum()
    return fitting.sigmoid(np.log((mean + 1e-4) / (1 - mean + 1e-4)) * field.out[0] + field.out[2])


@pytest.mark.parametrize(("lines", "size"), [(4096, 1 << 20), (1, 7), (3, 20)])
def test_quality_equals_enumeration(monkeypatch, lines, size):
    monkeypatch.setattr(quality, "CHUNK_LINES", lines)
    monkeypatch.setattr(quality, "CHUNK_BYTES", size)
    rng = np.random.default_rng(7)
    field = quality.LineField(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)), np.array([0.7, -0.4, 0.2]))
    words = ["Aé", "b1", "!!", "http://x", "the", "the", "%%%", "\t", "\n", "\n", "End."]
    texts = ["", " \n\t\n", "one"] + [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(30)]
    texts += ["same\nsame\nother\nsame", "long line " * 300 + "\nshort"]
    for text in texts:
        if len([x for x in text.split("\n") if x.strip()]) <= 10:
            assert np.isclose(field.score(text), brute_quality(field, text)), text
    assert field.score(None) == field.score("")


def test_a_line_is_a_line_however_long():
    counts = quality.line_counts(b"Ab 1, " * 500_000)
    assert counts == (500_000, 500_000, 500_000, 0, 500_000, 0, 1_000_000, 2)
    assert [len(x) for x in quality.lines_of("x" * 5000 + "\n \ny")] == [5000, 1]


def test_every_language_can_be_predicted(spark):
    spell = lambda k: chr(0x4E00 + 7 * k) * 3 + " " + chr(0x4E01 + 7 * k) * 2
    rows = [(i, spell(i % 230) * 4, f"l{i % 230:03}") for i in range(230 * 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train_language(frame)
    assert len(model.languages) == 230
    with pytest.raises(ValueError, match="more than 200"):
        language.train_language(frame, most_languages=200)


def test_training_reads_a_bounded_number_of_characters(spark):
    rows = spark.range(4000).select(F.col("id"), F.lit("xx").alias("lang"), F.repeat(F.lit("a"), 500).alias("text"))
    drawn = fitting.sample_by_label(rows, "lang", F.col("id"), 3000, 5, F.length("text"), 100_000)
    assert 100 < drawn.count() < 320


def brute_language(model, text):
    """Chances of the languages from n-grams counted one by one."""
    folded = [c if ord(c) >= 128 or "a" <= c <= "z" else " " for c in text.lower()]
    counts = {}
    for order in language.ORDERS:
        for at in range(len(folded) - order + 1):
            value = 0
            for k, c in enumerate(folded[at : at + order], start=1):
                value = (value * 0x9E3779B97F4A7C15 + ord(c) + k) % 2**64
            bucket = value * 0xD6E8FEB86659FD93 % 2**64 >> 49
            counts[bucket] = counts.get(bucket, 0) + 1
    weights = {b: np.log1p(n) * model.idf[b] for b, n in counts.items()}
    norm = np.sqrt(sum(w * w for w in weights.values()))
    logits = sum(w / norm * model.weights[b] for b, w in weights.items()) + model.bias
    e = np.exp(logits / model.temperature)
    return e / e.sum()


def test_language_chances_equal_brute_force():
    rows = [("the quick brown fox", "en"), ("der schnelle braune Fuchs", "de"), ("le renard brun été", "fr")] * 20
    model = language.fit_language(rows)
    for text in ("The fox, 1 der!", "été x", "ß", "a" * 50):
        chances = brute_language(model, text)
        name, score = model.predict(text)
        assert name == model.languages[int(chances.argmax())] and np.isclose(score, chances.max(), atol=1e-6)


def test_samples_are_bounded(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 50 == 0, "rare").otherwise("common").alias("label"))
    drawn = fitting.sample_by_label(rows, "label", F.col("id"), 200, 5).groupBy("label").count().collect()
    found = {r.label: r["count"] for r in drawn}
    assert found["rare"] == 100 and 120 < found["common"] < 300
    assert fitting.sample_by_label(rows.limit(0), "label", F.col("id"), 200, 5).count() == 0
