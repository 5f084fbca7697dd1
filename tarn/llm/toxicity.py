"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import map_rows, picked, small_batches
from tarn.llm.fitting import labelled_sample, logistic, sigmoid, softmax

BITS = 17
BUCKETS = 1 << BITS
ORDERS = (3, 4, 5, 6)
#: Words in a bag; a text is the sequence of its bags.
BAG = 4
#: Bytes of text handled at once.
BLOCK = 1 << 18

#: A-Z to a-z, other ASCII than letters and digits to a space; bytes of other characters stay.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def ngrams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order, buckets) of all character n-grams, one for each place they can start at."""
    codes = data.astype(np.uint64)
    hashes = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]
    for order in range(3, max(ORDERS) + 1):
        if len(data) < order:
            return
        hashes = hashes[: len(data) - order + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[order - 1 :]
        mixed = (hashes + np.uint64(order)) * np.uint64(0xD6E8FEB86659FD93)
        yield order, (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def subwords(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, word number) of each character n-gram of each word, and the number of words.

    Words are padded with one space on each side; an n-gram has a space at its
    ends only.
    """
    words = text.translate(FOLD).split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    spaces = np.cumsum(data == 32)
    buckets, owners = [], []
    for order, found in ngrams(data):
        at = np.flatnonzero(spaces[order - 2 : len(data) - 1] == spaces[: len(data) - order + 1])
        buckets.append(found[at])
        owners.append(spaces[at] - 1)
    return np.concatenate(buckets), np.concatenate(owners), len(words)


def blocks_of(data: bytes, size: int) -> Iterator[bytes]:
    """Folded text in blocks of about ``size`` bytes that end at a space, so that no word is cut."""
    at = 0
    while len(data) - at > size:
        cut = data.find(b" ", at + size)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def long_word(word: bytes, scores: np.ndarray) -> float:
    """The mean score of the subwords of a word of any length, a stretch of it at a time."""
    data, total, count = np.frombuffer(b" " + word + b" ", dtype=np.uint8), 0.0, 0
    for at in range(0, len(data), BLOCK):
        for _, found in ngrams(data[at : at + BLOCK + max(ORDERS) - 1]):
            total += float(scores[found[:BLOCK]].sum())
            count += min(len(found), BLOCK)
    return total / max(1, count)


@dataclass
class ToxicityModel:
    """``scores`` is each subword's embedding times the difference of the two output vectors.

    As the softmax is linear in the embeddings, a bag's averaged embedding times
    that difference is the average of its subwords' scores.
    """

    scores: np.ndarray
    bias: float

    def word_scores(self, text: str | None) -> Iterator[np.ndarray]:
        """The mean score of each word's subwords, in blocks of words."""
        data = (text or "").lower().encode("utf-8", "surrogatepass").translate(FOLD)
        for block in blocks_of(data, BLOCK):
            words = block.split()
            if len(block) > 2 * BLOCK:
                # Its last word reaches far beyond the block: all others end within it.
                last = words.pop()
                yield from (self._means(b" ".join(words)), np.array([long_word(last, self.scores)]))
            else:
                yield self._means(block)

    def _means(self, block: bytes) -> np.ndarray:
        buckets, owners, count = subwords(block)
        if not count:
            return np.zeros(0)
        sums = np.bincount(owners, self.scores[buckets], minlength=count)
        return sums / np.maximum(np.bincount(owners, minlength=count), 1)

    def logit(self, text: str | None) -> float:
        """The softmax's log odds for the text's most toxic bag; for a text without words those of an empty bag."""
        top, held = None, np.zeros(0)
        for found in self.word_scores(text):
            # A block's last words go into the next one's bags.
            held = np.concatenate([held, found])
            if len(held) >= BAG:
                best = float(bag_means(held).max())
                top = best if top is None else max(top, best)
                held = held[len(held) - BAG + 1 :]
        if top is None:
            top = float(held.mean()) if len(held) else 0.0
        return top + self.bias

    def score(self, text: str | None) -> float:
        return sigmoid(self.logit(text))


def bag_means(words: np.ndarray) -> np.ndarray:
    """Mean over each run of ``BAG`` words, at every start (the whole text if it is shorter)."""
    if len(words) <= BAG:
        return np.array([words.mean()])
    total = np.concatenate([[0.0], np.cumsum(words)])
    return (total[BAG:] - total[:-BAG]) / BAG


class Corpus:
    """A training sample as word numbers, with the subwords of each distinct word."""

    def __init__(self, texts: list[str]):
        number: dict[bytes, int] = {}
        self.docs = []
        for text in texts:
            words = text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split()
            self.docs.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32))
        self.buckets, owners, words = subwords(b" ".join(number))
        by = np.argsort(owners, kind="stable")
        self.buckets = self.buckets[by]
        self.counts = np.bincount(owners, minlength=words)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def word_scores(self, scores: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(scores[self.buckets])])
        return (total[self.starts[1:]] - total[self.starts[:-1]]) / np.maximum(self.counts, 1)

    def gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat subword buckets of the given words and the place of each one's word."""
        counts = self.counts[words]
        place = np.repeat(np.arange(len(words)), counts)
        within = np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.buckets[self.starts[words][place] + within], place


def fit_toxicity(
    rows: list[tuple[str, int]], *, dims: int = 8, epochs: int = 6, bags_per_doc: int = 30, rate: float = 0.15
) -> ToxicityModel:
    """Train embeddings and softmax together on bags of words, by Adagrad.

    A label holds for a document, so the first pass learns from random bags of
    all documents; later ones take a toxic document's highest bags as toxic and
    a clean document's random and highest bags as clean.  A fifth of the rows is
    kept to calibrate the softmax (its temperature and bias) on whole documents.
    Rows of one label, or none, give a model that always says that label, or 0.
    """
    rng = np.random.default_rng(0)
    labels = np.array([label for _, label in rows], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros(BUCKETS), 20.0 if labels.any() else -20.0)
    corpus = Corpus([text for text, _ in rows])
    fitted = np.flatnonzero(np.arange(len(rows)) % 5 != 4)
    table = rng.normal(0, 0.1, (BUCKETS, dims))
    out, bias = rng.normal(0, 0.1, (2, dims)), np.zeros(2)
    sums = [np.full((BUCKETS, 1), 1e-6), np.full((2, dims), 1e-6), np.full(2, 1e-6)]
    for epoch in range(epochs):
        scores = corpus.word_scores(table @ (out[1] - out[0]))
        bags, wanted = [], []
        for k in fitted:
            words = corpus.docs[k]
            if not len(words):
                continue
            last = max(1, len(words) - BAG + 1)
            starts = rng.integers(0, last, min(bags_per_doc, last))
            if epoch:
                ranked = np.argsort(-bag_means(scores[words]))
                top = ranked[: max(1, last // 50)] if labels[k] else ranked[:4]
                starts = top[: bags_per_doc] if labels[k] else np.concatenate([top, starts])
            bags += [words[s : s + BAG] for s in starts.tolist()]
            wanted += [labels[k]] * len(starts)
        share = np.bincount(np.array(wanted), minlength=2) / len(wanted)
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 256):
            chosen = order[at : at + 256]
            sizes = np.array([len(bags[k]) for k in chosen])
            flat = np.concatenate([bags[k] for k in chosen])
            bag = np.repeat(np.arange(len(chosen)), sizes)
            ids, place = corpus.gather(flat)
            weight = (1.0 / np.maximum(corpus.counts[flat], 1))[place] / sizes[bag[place]]
            owner = bag[place]
            mean = np.zeros((len(chosen), dims))
            np.add.at(mean, owner, table[ids] * weight[:, None])
            y = np.array([wanted[k] for k in chosen])
            slope = softmax(mean @ out.T + bias)
            slope[np.arange(len(y)), y] -= 1.0
            slope *= (0.5 / np.maximum(share[y], 1e-3))[:, None]
            inner = slope @ out
            to_out, to_bias = slope.T @ mean, slope.sum(axis=0)
            unique, back = np.unique(ids, return_inverse=True)
            to_table = np.zeros((len(unique), dims))
            np.add.at(to_table, back, inner[owner] * weight[:, None])
            sums[0][unique] += (to_table**2).mean(axis=1, keepdims=True)
            table[unique] -= rate * to_table / np.sqrt(sums[0][unique])
            for value, change, total in ((out, to_out, sums[1]), (bias, to_bias, sums[2])):
                total += change**2
                value -= rate * change / np.sqrt(total)
    model = ToxicityModel(table @ (out[1] - out[0]), float(bias[1] - bias[0]))
    aside = [k for k in range(len(rows)) if k % 5 == 4] if len(rows) >= 50 else list(range(len(rows)))
    if len(set(labels[aside].tolist())) == 2:
        slope, shift = logistic(np.array([[model.logit(rows[k][0])] for k in aside]), labels[aside])
        if slope > 0:
            model = ToxicityModel(slope * model.scores, float(slope * model.bias + shift))
    return model


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    rows_per_label: int = 1500,
    most_chars: int = 20_000,
    holdout: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Fit on a bounded sample: about ``rows_per_label`` labelled texts of each class, of at most ``most_chars``.

    Rows with a null id, a null text or another label than 0 and 1 are not
    learned from, nor those whose id has remainder 1 (see ``id_remainder``); a
    repeated label row counts once; other columns are ignored.  Empty tables
    give a model that always says 0.
    """
    return fit_toxicity(
        labelled_sample(
            docs, labels, label_col, rows_per_label=rows_per_label, most_chars=most_chars,
            holdout=holdout, id_col=id_col, text_col=text_col,
        )
    )


def score_texts(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: ``model.score`` of its whole text, and of nothing else.

    Null texts are scored as empty ones; null and repeated ids are carried as
    they are; other columns are ignored, whatever their names; long texts are
    scored in blocks; an empty table gives no rows.
    """
    texts = picked(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            scores = [model.score(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return map_rows(texts, f"doc_id {id_type}, score double", work)
