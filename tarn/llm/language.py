"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import by_place, map_rows, picked, position, small_batches
from tarn.llm.fitting import char_blocks, code_points, id_remainder, sample_by_label, softmax

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of a text's lower-cased character 1- to 3-grams; ASCII other than letters is a space."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    longest = max(ORDERS)
    lowered = text.lower()
    for k, block in enumerate(char_blocks(lowered, 1 << 20, longest - 1)):
        points = code_points(block).astype(np.uint64)
        points = np.where((points < 128) & ((points < 97) | (points > 122)), np.uint64(32), points)
        hashes = np.zeros(len(points), dtype=np.uint64)
        for order in range(1, longest + 1):
            if len(points) < order:
                break
            hashes = hashes[: len(points) - order + 1] * np.uint64(0x9E3779B97F4A7C15) + points[order - 1 :] + np.uint64(order)
            mixed = (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 15)
            fresh = 0 if k == 0 else longest - order
            counts += np.bincount(mixed[fresh:].astype(np.int64), minlength=BUCKETS)
    return counts


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = ngram_counts(text)
        at = np.flatnonzero(counts)
        values = np.log1p(counts[at]) * self.idf[at]
        return at, values / max(1e-12, float(np.sqrt((values * values).sum())))

    def logits(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        chances = softmax(self.logits(*self.features(text)) / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def ftrl(
    model: LanguageModel,
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    *,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 2e-3,
    l2: float = 1e-3,
    epochs: int = 2,
) -> None:
    """Follow-the-regularised-leader with per-coordinate rates and elastic-net penalties."""
    classes = len(model.languages)
    z, n = (np.zeros((BUCKETS + 1, classes), np.float64 if classes <= 200 else np.float32) for _ in range(2))

    def weights(at: np.ndarray) -> np.ndarray:
        za = z[at]
        shrunk = np.sign(za) * l1 - za
        found = shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)
        found[np.abs(za) <= l1] = 0.0
        return found

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, values, label = rows[k]
            at, values = np.append(at, BUCKETS), np.append(values, 1.0)
            w = weights(at)
            slope = softmax(values @ w)
            slope[label] -= 1.0
            g = values[:, None] * slope
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rate * w
            n[at] += g * g
    every = weights(np.arange(BUCKETS + 1))
    model.weights, model.bias = every[:-1].astype(np.float32), every[-1]


def calibrate(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The temperature with the least log loss on rows not fitted on, by golden-section search."""
    if not rows:
        return
    logits = np.array([model.logits(at, values) for at, values, _ in rows])
    labels = np.array([label for *_, label in rows])

    def loss(log_t: float) -> float:
        chances = softmax(logits / np.exp(log_t))
        return -float(np.log(np.maximum(chances[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    model.temperature = float(np.exp((low + high) / 2))


def fit_language(texts: list[tuple[str, str]]) -> LanguageModel:
    """A model of (text, language) rows; every tenth row is kept for calibration."""
    texts = [(t, lang) for t, lang in texts if lang is not None and has_letter(t)]
    languages = sorted({lang for _, lang in texts})
    model = LanguageModel(languages, np.ones(BUCKETS), np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)))
    seen = np.zeros(BUCKETS)
    for text, _ in texts:
        seen += ngram_counts(text) > 0
    model.idf = np.log((1 + len(texts)) / (1 + seen)) + 1
    rows = [(*model.features(t), languages.index(lang)) for t, lang in texts]
    aside = [r for k, r in enumerate(rows) if k % 10 == 9]
    ftrl(model, [r for k, r in enumerate(rows) if k % 10 != 9])
    calibrate(model, aside)
    return model


def train_language(
    docs: DataFrame,
    *,
    rows_per_language: int = 1000,
    chars_per_language: int = 8 << 20,
    most_languages: int = 1000,
    most_chars: int = 20_000,
    holdout: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Fit on a bounded sample: about ``rows_per_language`` rows and ``chars_per_language`` characters of each language.

    Rows with a null language, null texts, texts of over ``most_chars``
    characters and rows whose id has remainder 0 (see ``id_remainder``) are not
    learned from.  Every language left can be predicted: a table with more than
    ``most_languages`` is refused.  Repeated rows count like others; other
    columns are ignored; an empty table gives a model that knows no language.
    """
    rows = picked(docs, id=id_col, text=text_col, lang=lang_col)
    rows = rows.select("id", F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.where((id_remainder("id", holdout) != 0) & F.col("lang").isNotNull() & (F.length("text") <= most_chars))
    drawn = sample_by_label(rows, "lang", F.col("id"), rows_per_language, most_languages, F.length("text"), chars_per_language)
    return fit_language([(r.text, r.lang) for r in drawn.select("text", "lang").collect()])


def identify_language(
    docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text alone.

    ``lang_pred`` is a learned language, or ``und`` with score 0 if the text is
    null, has no letter, or nothing was learned; of languages with one score the
    first by name.  Ids are carried as they are, null and repeated ones too;
    other columns are ignored, whatever their names; long texts are counted in
    blocks; an empty table gives no rows.
    """
    texts = picked(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            found = [model.predict(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([f for f, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    return map_rows(texts, schema, work)


def keep_known_language(
    docs: DataFrame, training: DataFrame, *, least_score: float = 0.3, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with a named language of score ``least_score`` or more; all columns are kept, whatever their names.

    Null texts and texts without a letter have no named language and go;
    repeated rows are judged alike; long texts are counted in blocks; an empty
    table stays empty.  ``training`` is read as ``train_language`` reads it.
    """
    model = train_language(training)
    text_at, placed = position(docs, text_col), by_place(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            found = [model.predict(t) for t in part.column(text_at).to_pylist()]
            yield part.filter(pa.array([f != UNKNOWN and s >= least_score for f, s in found], pa.bool_()))

    return map_rows(placed, T.StructType(placed.schema.fields), work).toDF(*docs.columns)
