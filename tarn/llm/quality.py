"""Quality classifier: a linear-chain conditional random field over a document's lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import batched
from math import exp, log1p

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from tarn.llm.fitting import labelled_sample, logistic, sigmoid

GOOD, BAD = 1, 0
#: Lines of a text whose features are held at once; of a line between chunks a few numbers stay.
CHUNK_LINES = 4096
#: Bytes of a line that are taken apart at once.
CHUNK_BYTES = 1 << 20

UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
DIGIT = bytes(range(0x30, 0x3A))
SPACE = b" \t\v\f\r"
STOPS = b".!?,;:'\"()-"
SYMBOL = bytes(b for b in range(0x21, 0x7F) if b not in UPPER + LOWER + DIGIT + STOPS)
EDGES = {
    "length": (20, 60, 120, 240, 480, 960),
    "word": (2.5, 3.5, 4.5, 6.0, 8.0, 12.0),
    "upper": (0.02, 0.1, 0.3, 0.7),
    "digit": (0.001, 0.05, 0.15, 0.4),
    "symbol": (0.001, 0.02, 0.08, 0.2),
    "stop": (0.005, 0.02, 0.05, 0.1, 0.2),
    "wide": (0.001, 0.05, 0.15, 0.4),
    "distinct": (0.2, 0.4, 0.6, 0.8, 0.95),
    "seen": (0.5, 1.5, 3.5, 10.5),
}
OFFSETS = np.cumsum([0] + [len(e) + 1 for e in EDGES.values()])
OWN = int(OFFSETS[-1]) + 3
#: A line's own features, those of the line before and of the line after, and two for a missing neighbour.
WIDTH = 3 * OWN + 2


def lines_of(text: str) -> Iterator[bytes]:
    """A text's non-blank lines."""
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line and not line.isspace():
            yield line.encode("utf-8", "surrogatepass")
        at = end + 1


def pieces(line: bytes) -> Iterator[bytes]:
    """A long line in pieces that end at a space where there is one within reach."""
    at = 0
    while len(line) - at > CHUNK_BYTES:
        cut = line.rfind(b" ", at, at + CHUNK_BYTES) + 1 or at + CHUNK_BYTES
        yield line[at:cut]
        at = cut
    yield line[at:]


def line_counts(line: bytes) -> tuple[int, ...]:
    """(letters A-Z, a-z, digits, symbols, stops, other bytes, words, distinct words) of a line."""
    sums, distinct = np.zeros(7, dtype=np.int64), []
    for raw in pieces(line):
        words = raw.split()
        plain = raw.translate(None, UPPER)
        found = [len(raw) - len(plain)]
        for some in (LOWER, DIGIT, SYMBOL, STOPS):
            less = plain.translate(None, some)
            found.append(len(plain) - len(less))
            plain = less
        sums += (*found, len(plain.translate(None, SPACE)), len(words))
        distinct.append(set(words))
    if len(distinct) > 1:
        hashes = np.concatenate([np.fromiter(map(xxhash.xxh64_intdigest, d), np.uint64, len(d)) for d in distinct])
        return (*sums.tolist(), len(np.unique(hashes)))
    return (*sums.tolist(), len(distinct[0]))


def seen_before(lines: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each line how often it was met before in the text, and its length in bytes."""
    names, lengths = [], []
    for part in batched(lines, CHUNK_LINES):
        names.append(np.fromiter(map(xxhash.xxh64_intdigest, part), np.uint64, len(part)))
        lengths.append(np.fromiter(map(len, part), np.int64, len(part)))
    if not names:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.concatenate(names)
    order = np.argsort(hashes, kind="stable")
    sorted_names = hashes[order]
    heads = np.maximum.accumulate(np.where(np.concatenate([[True], sorted_names[1:] != sorted_names[:-1]]), np.arange(len(order)), 0))
    seen = np.empty(len(order), dtype=np.int64)
    seen[order] = np.arange(len(order)) - heads
    return seen, np.concatenate(lengths)


def own_features(lines: Sequence[bytes], seen: np.ndarray) -> np.ndarray:
    """Numbers of the active features of each line; ``seen`` says how often it was met before in the text."""
    values = np.zeros((len(lines), len(EDGES)))
    flags = np.zeros((len(lines), 3), dtype=bool)
    for k, line in enumerate(lines):
        n = len(line)
        upper, lower, digit, symbol, stop, wide, words, distinct = line_counts(line)
        values[k] = (
            n,
            (n - words + 1) / max(1, words),
            upper / max(1, upper + lower),
            digit / n,
            symbol / n,
            stop / n,
            wide / n,
            distinct / max(1, words),
            seen[k],
        )
        flags[k] = line.rstrip()[-1:] in (b".", b"!", b"?"), b"http" in line or b"www" in line, b"!!" in line
    columns = [
        OFFSETS[j] + np.searchsorted(edges, values[:, j], side="right") for j, edges in enumerate(EDGES.values())
    ]
    columns += [np.where(flags[:, j], OFFSETS[-1] + j, -1) for j in range(3)]
    return np.column_stack(columns)


def text_features(text: str) -> np.ndarray | None:
    """The active features of all lines of a text, for training; None if it has no lines."""
    lines = list(lines_of(text))
    return neighbour_features(own_features(lines, seen_before(iter(lines))[0])) if lines else None


def neighbour_features(own: np.ndarray) -> np.ndarray:
    """Active features of each line with those of its neighbours; -1 is none."""
    shift = lambda rows, by: np.where(rows >= 0, rows + by, -1)
    before = np.full_like(own, -1)
    after = np.full_like(own, -1)
    before[1:], after[:-1] = shift(own[:-1], OWN), shift(own[1:], 2 * OWN)
    missing = np.full((len(own), 2), -1)
    missing[0, 0], missing[-1, 1] = 3 * OWN, 3 * OWN + 1
    return np.hstack([own, before, after, missing])


@dataclass
class LineField:
    """Scores of the label 'good' over 'bad' for each feature, and of each pair of neighbouring labels."""

    weights: np.ndarray
    pairs: np.ndarray
    out: np.ndarray

    def unary(self, active: np.ndarray) -> np.ndarray:
        good = self.lean(active)
        return np.column_stack([np.zeros(len(good)), good])

    def lean(self, active: np.ndarray) -> np.ndarray:
        """How much each line's features speak for 'good'."""
        return np.append(self.weights, 0.0)[active].sum(axis=1)

    def score(self, text: str | None) -> float:
        return sigmoid(self.summary(text) @ self.out[:-1] + self.out[-1])

    def leans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(lean, length) of each line; features are held for a chunk of lines with a neighbour on each side."""
        seen, lengths = seen_before(lines_of(text))
        found, before, at = np.empty(len(seen)), None, 0
        part: list[bytes] = []
        after = iter(batched(lines_of(text), CHUNK_LINES))
        own, following = None, next(after, None)
        while following is not None:
            part, following = following, next(after, None)
            own = own_features(part, seen[at : at + len(part)]) if own is None else own
            coming = None
            if following is not None:
                coming = own_features(following, seen[at + len(part) : at + len(part) + len(following)])
            edges = [x for x in (before, own, coming[:1] if coming is not None else None) if x is not None]
            active = neighbour_features(np.vstack(edges))
            skip = before is not None
            found[at : at + len(part)] = self.lean(active[skip : skip + len(part)])
            before, own, at = own[-1:], coming, at + len(part)
        return found, lengths

    def summary(self, text: str | None) -> np.ndarray:
        """Log odds of the length-weighted mean chance of a good line, and whether there are lines at all."""
        lean, lengths = self.leans(text or "")
        if not len(lean):
            return np.array([0.0, 1.0])
        good = chances(lean, self.pairs)
        mean = float((good * lengths).sum() / lengths.sum())
        return np.array([np.log((mean + 1e-4) / (1 - mean + 1e-4)), 0.0])


def chances(lean: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The marginal chance of 'good' at each line, by forward-backward on log odds, a number a line each way."""
    (p00, p01), (p10, p11) = pairs.tolist()
    merge, odds = logaddexp, np.empty(len(lean))
    x = None
    for at in range(0, len(lean), CHUNK_LINES):
        out = []
        for u in lean[at : at + CHUNK_LINES].tolist():
            x = u if x is None else u + merge(p01, x + p11) - merge(p00, x + p10)
            out.append(x)
        odds[at : at + len(out)] = out
    x = 0.0
    for at in range(len(lean) - 1, 0, -1):
        u = x + float(lean[at])
        x = merge(p10, p11 + u) - merge(p00, p01 + u)
        odds[at - 1] += x
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def messages(unary: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log forward and backward messages of a two-label chain."""
    a, b = np.empty_like(unary), np.zeros_like(unary)
    (p00, p01), (p10, p11) = pairs.tolist()
    x, y = unary[0].tolist()
    forward, backward = [(x, y)], []
    merge = logaddexp
    for u, v in unary[1:].tolist():
        x, y = u + merge(x + p00, y + p10), v + merge(x + p01, y + p11)
        forward.append((x, y))
    x = y = 0.0
    backward.append((x, y))
    for u, v in unary[:0:-1].tolist():
        x, y = merge(u + p00 + x, v + p01 + y), merge(u + p10 + x, v + p11 + y)
        backward.append((x, y))
    a[:], b[:] = forward, backward[::-1]
    return a, b


def logaddexp(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x + log1p(exp(y - x))


def marginals(unary: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Chances of both labels at each line, by forward-backward."""
    a, b = messages(unary, pairs)
    joint = a + b
    top = np.exp(joint - joint.max(axis=1, keepdims=True))
    return top / top.sum(axis=1, keepdims=True)


def pair_marginals(unary: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Summed chances of each pair of neighbouring labels."""
    if len(unary) < 2:
        return np.zeros((2, 2))
    a, b = messages(unary, pairs)
    joint = a[:-1, :, None] + pairs[None] + (unary[1:] + b[1:])[:, None, :]
    top = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    return (top / top.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fit_quality(
    rows: list[tuple[str, int]], *, epochs: int = 6, rate: float = 0.1, penalty: float = 1e-3, most_lines: int = 60
) -> LineField:
    """Maximum conditional likelihood by Adagrad on documents, each line carrying its document's label.

    Both classes weigh the same.  Of a sampled document with more than
    ``most_lines`` lines the chain is fitted on a stretch of that many; scoring
    always takes all lines.  A fifth of the sample calibrates the document score.
    Rows of one label, or none, give a field that always says that label, or 0;
    texts without lines are learned from in the calibration alone.
    """
    rng = np.random.default_rng(0)
    labels = np.array([label for _, label in rows], dtype=np.int64)
    field = LineField(np.zeros(WIDTH), np.zeros((2, 2)), np.array([1.0, 0.0, 0.0]))
    if len(set(labels.tolist())) < 2:
        field.out = np.array([0.0, 0.0, 20.0 if labels.any() else -20.0])
        return field
    active = [text_features(text) for text, _ in rows]
    fitted = [k for k in range(len(rows)) if k % 5 != 4 and active[k] is not None]
    weight = 0.5 * len(fitted) / np.maximum(1, np.bincount(labels[fitted], minlength=2))
    sums = [np.full(WIDTH, 1e-6), np.full((2, 2), 1e-6)]
    for _ in range(epochs):
        for k in rng.permutation(fitted):
            part = active[k]
            if len(part) > most_lines:
                at = int(rng.integers(0, len(part) - most_lines + 1))
                part = part[at : at + most_lines]
            unary = field.unary(part)
            good = marginals(unary, field.pairs)[:, GOOD]
            slope = weight[labels[k]] * (good - labels[k]) / len(part)
            to_weights = np.bincount(
                np.where(part >= 0, part, WIDTH).ravel(), np.repeat(slope, part.shape[1]), minlength=WIDTH + 1
            )[:WIDTH] + penalty * field.weights / 10
            wanted = np.zeros((2, 2))
            wanted[labels[k], labels[k]] = max(0, len(part) - 1)
            to_pairs = weight[labels[k]] * (pair_marginals(unary, field.pairs) - wanted) / len(part) + penalty * field.pairs
            for value, change, total in ((field.weights, to_weights, sums[0]), (field.pairs, to_pairs, sums[1])):
                total += change**2
                value -= rate * change / np.sqrt(total)
    aside = [k for k in range(len(rows)) if k % 5 == 4] if len(rows) >= 50 else list(range(len(rows)))
    if len(set(labels[aside].tolist())) == 2:
        field.out = logistic(np.array([field.summary(rows[k][0]) for k in aside]), labels[aside])
    return field


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    rows_per_label: int = 1500,
    most_chars: int = 20_000,
    holdout: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> LineField:
    """Fit on a bounded sample: about ``rows_per_label`` labelled texts of each class, of at most ``most_chars``.

    Rows with a null id, a null text or another label than 0 and 1 are not
    learned from, nor those whose id has remainder 1 (see ``id_remainder``); a
    repeated label row counts once; other columns are ignored.  Empty tables
    give a field that always says 0.
    """
    return fit_quality(
        labelled_sample(
            docs, labels, label_col, rows_per_label=rows_per_label, most_chars=most_chars,
            holdout=holdout, id_col=id_col, text_col=text_col,
        )
    )
