"""What the classifiers share: bounded training samples and text as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import picked


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def sample_by_label(
    rows: DataFrame, label_col: str, key: Column, rows_per_label: int, most_labels: int, size: Column | None = None, size_per_label: int = 0
) -> DataFrame:
    """About ``rows_per_label`` rows of each label, at most 1.2 times as many in all; with ``size`` no more than about ``size_per_label`` of it either.

    Rows are drawn by a hash of ``key``, so the same rows are drawn however the
    table is split.  The counts are exact and over all rows; the bound holds at
    any size of the table.  More than ``most_labels`` labels are refused: none
    is left out.  Rows with a null label are not drawn.
    """
    held = F.lit(0.0) if size is None else F.sum(size.cast("double"))
    counts = rows.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count("*").alias("n"), held.alias("size")).limit(most_labels + 1)
    found = counts.collect()
    if len(found) > most_labels:
        raise ValueError(f"{label_col} has more than {most_labels} values: not a column of labels, or one to raise the limit for")
    if not found:
        return rows.limit(0)
    share = [
        (r[0], float(min(1.0, rows_per_label / r.n, size_per_label / r.size if size_per_label and r.size else 1.0))) for r in found
    ]
    kind = rows.schema[label_col].dataType.simpleString()
    shares = rows.sparkSession.createDataFrame(share, f"`{label_col}` {kind}, __share double")
    ticket = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    most = int(1.2 * rows_per_label * len(share)) + 100
    drawn = rows.join(F.broadcast(shares), label_col).where(ticket < F.col("__share")).select(*rows.columns)
    return drawn.orderBy(F.xxhash64(key, F.lit("order"))).limit(most)


def char_blocks(text: str, size: int, overlap: int) -> Iterator[str]:
    """A text in blocks of bounded size, each beginning with the last ``overlap`` characters of the one before."""
    for at in range(0, max(1, len(text)), size):
        yield text[max(0, at - overlap) : at + size]


def logistic(features: np.ndarray, labels: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights (intercept last) of a small logistic regression, by damped Newton steps."""
    middle, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([(features - middle) / spread, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([penalty * len(labels) / 10] * features.shape[1] + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - labels) + ridge @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * middle / spread).sum())


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    *,
    rows_per_label: int,
    most_chars: int,
    holdout: int,
    id_col: str,
    text_col: str,
) -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of labelled documents outside the held-out ids.

    The sample is drawn from the labels, whose ids are few enough to be sent to
    the readers of the documents: no text is shuffled.
    """
    rows = picked(labels, id=id_col, label=label_col).withColumn("label", F.col("label").cast("int"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (id_remainder("id", holdout) != 1))
    drawn = sample_by_label(rows, "label", F.col("id"), rows_per_label, 2).dropDuplicates(["id"])
    texts = picked(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    texts = texts.where(F.length("text") <= most_chars).join(F.broadcast(drawn), "id")
    found = texts.orderBy(F.xxhash64("id"), "text", "label").limit(3 * rows_per_label + 200)
    return [(r.text, r.label) for r in found.select("text", "label").collect()]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def softmax(logits: np.ndarray) -> np.ndarray:
    top = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return top / top.sum(axis=-1, keepdims=True)
