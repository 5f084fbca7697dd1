"""A text's score by definition, and wherever a long one is cut into blocks."""

import math

import numpy as np
import pytest

from tarn.llm import toxicity as T


def brute(model, text):
    """The softmax of each bag's averaged embedding, spelled out; the highest is the text's."""
    words = text.lower().encode().translate(T.FOLD).split()
    if not words:
        return 1 / (1 + math.exp(-model.bias))
    means = []
    for word in words:
        buckets, _, _ = T.subwords(word)
        means.append(sum(model.scores[b] for b in buckets.tolist()) / len(buckets))
    bags = [means[k : k + T.BAG] for k in range(max(1, len(words) - T.BAG + 1))]
    return max(1 / (1 + math.exp(-(sum(b) / len(b) + model.bias))) for b in bags)


@pytest.mark.parametrize("block", [1 << 18, 1, 40, 333])
def test_scores_equal_brute_force(monkeypatch, block):
    rng = np.random.default_rng(4)
    model = T.ToxicityModel(rng.normal(size=1 << T.BITS), -0.3)
    texts = ["", "...", "one", "One, two-three", *(" ".join(f"w\u00e9{k}" for k in rng.integers(0, 500, n)) for n in (4, 5, 9, 60, 400))]
    texts += ["a " + "xy" * 500 + " b c d e", "z" * 999, "a.b.c" * 300]
    monkeypatch.setattr(T, "BLOCK", block)
    for text in texts:
        assert math.isclose(model.score(text), brute(model, text), rel_tol=1e-9), text[:40]
    assert model.score(None) == model.score("")


def test_memory_of_texts_without_spaces():
    model = T.ToxicityModel(np.ones(1 << T.BITS), 0.0)
    assert math.isclose(model.logit("x" * 3_000_000), 1.0) and math.isclose(model.logit("x." * 1_000_000), 1.0)
