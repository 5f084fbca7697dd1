import hashlib
import random

import numpy as np
import pytest

from tarn.llm import queries, repeats

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    """Spans by counting every window of every text."""
    counts = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            counts[w] = counts.get(w, 0) + 1
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                covered[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8)]))).tolist()
        out.append(list(zip(edges[::2], edges[1::2], strict=True)))
    return out


def corpus():
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, base = noise(300), noise(900)
    texts = [None, "", "short", noise(199), passage, passage[:60], "ab" * 150, "x" * 500, base, base, base[:400] + "#" + base[401:]]
    for _ in range(25):
        at = rng.randrange(0, 250)
        texts.append(noise(rng.randrange(0, 120)) + passage[at : at + rng.randrange(20, 300)] + noise(rng.randrange(0, 120)))
    for _ in range(25):
        edited = list(base)
        for _ in range(rng.randrange(1, 6)):
            edited[rng.randrange(len(base))] = "Z"
        texts.append("".join(edited))
    texts.append(noise(300) + passage + noise(100) + passage)
    return texts


def check(spark, length, limit):
    texts = corpus()
    rows = [(k if k % 7 else None, t, "r", 1) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string, n int").repartition(3)
    found = repeats.remove_repeats(frame, length=length, group_limit=limit).collect()
    data = [(t or "").encode() for t in texts]
    expected = []
    for (doc, *_), t, spans in zip(rows, data, brute(data, length), strict=True):
        expected.append((str(doc), len(t), spans, repeats.kept_bytes(t, spans)))
    got = [(str(r.doc_id), r.n_bytes, [(s.start, s.end) for s in r.removed], bytes(r.kept)) for r in found]
    assert sorted(got) == sorted(expected)
    assert sum(bool(s) for *_, s, _ in expected) > 10


@pytest.mark.parametrize(("length", "limit"), [(64, 8192), (64, 2), (50, 8192), (200, 8192)])
def test_equals_brute_force(spark, length, limit):
    check(spark, length, limit)


@pytest.mark.parametrize("limit", [8192, 2])
def test_names_that_collide(spark, limit, monkeypatch):
    """Stretches and windows that share a name are told apart by their bytes, then named anew."""
    one_name = (lambda stretch: len(stretch) % 5, lambda window: window[:3])
    monkeypatch.setattr(repeats, "NAMERS", (one_name, repeats.NAMERS[1]))
    check(spark, 64, limit)


def test_anchors_that_collide():
    """Stretches of one group number whose anchors differ share no window."""
    rng = np.random.default_rng(1)
    side = rng.integers(97, 101, 40, dtype=np.uint8).tobytes()
    grams = [rng.integers(97, 101, repeats.GRAM, dtype=np.uint8).tobytes() for _ in range(2)]
    stretches = [side + grams[k] + side for k in (0, 1, 0)]
    leads, counts = np.full(3, 40), np.full(3, 41)
    found = repeats.repeated_windows(np.zeros(3, np.int64), stretches, leads, counts, np.ones(3, np.int64), 72)
    assert found[0].all() and found[2].all() and not found[1].any()


def test_pieces_of_long_texts_share_no_window(monkeypatch):
    monkeypatch.setattr(repeats, "BUFFER", 300)
    text = bytes(np.random.default_rng(0).integers(97, 101, 1700, dtype=np.uint8))
    found = repeats.Supermers([b"tiny", text], 64, repeats.NAMERS[0][0])
    starts = sorted(s + k for s, c in zip(found.start.tolist(), found.count.tolist(), strict=True) for k in range(c))
    assert starts == list(range(len(text) - 64 + 1)) and set(found.doc.tolist()) == {1}


def test_query_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    data = [d.text.encode() for d in docs]
    expected = {}
    for d, t, spans in zip(docs, data, brute(data, 200), strict=True):
        kept = hashlib.sha256(repeats.kept_bytes(t, spans)).hexdigest()
        expected[d.doc_id] = (len(t), sum(b - a for a, b in spans), len(spans), kept)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_suffix_dedup(spark, SF).collect()}
    assert found == expected and any(n for _, n, _, _ in found.values())


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
