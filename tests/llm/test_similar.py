"""Sketches of shingle sets, and names of sets."""

import random

import numpy as np

from tarn.llm import similar


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_sketches_part_only_what_is_far_below():
    rng = random.Random(3)
    low, high = [], []
    for _ in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        copy = base[:]
        for _ in range(rng.choice([1, 4, 7, 40, 80])):
            copy[rng.randrange(300)] = f"w{rng.randrange(10**6)}"
        a, b = " ".join(base), " ".join(copy)
        exact = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        x, y = (similar.distinct_hashes(t.encode(), 5) for t in (a, b))
        s, z = (similar.majority(h, range(100, 100 + similar.SKETCH)) for h in (x, y))
        apart = sum((p ^ q).bit_count() for p, q in zip(s, z, strict=True))
        found = bool(similar.similar(np.array(apart), float(len(x)), float(len(y)), 0.4))
        if exact < 0.2:
            low.append(found)
        elif exact >= 0.8:
            high.append(found)
    assert not any(low) and all(high) and len(low) > 20 and len(high) > 50


def test_majority_over_parts():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    for number, got in zip(range(4), similar.majority(hashes, range(4)), strict=True):
        mixed = similar.remixed(hashes, number).tolist()
        assert got == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > 1000)
    assert similar.majority(np.zeros(0, np.uint64), range(2)) == [0, 0]


def test_shared_names_have_all_named_anew(spark, monkeypatch):
    plain = similar.set_name
    monkeypatch.setattr(similar, "set_name", lambda h, seed: (7 if seed == 0 and len(h) % 2 else plain(h, seed)[0], plain(h, seed)[1]))
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (11, 11, 12, 13, 40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.drop_near(frame).collect()) == [0, 1, 2, 3, 4]


def changed_copies():
    """Rows of 30 texts, each with a copy that differs in one word of 300."""
    rng, rows = random.Random(4), []
    for k in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((2 * k, " ".join(base)))
        base[rng.randrange(300)] = "other"
        rows.append((2 * k + 1, " ".join(base)))
    return rows


def test_fingerprints_within_the_radius_are_linked(spark):
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), k % 7)) for k, p in enumerate(prints)]
    frame = spark.createDataFrame([(k, similar.signed(p)) for k, p in enumerate(prints)], "node long, fp long")
    with similar.Workspace(spark) as ws:
        found = {r.node: r.root for r in similar.fingerprint_roots(ws, frame, 4, 16384).collect()}
    assert found == {k: k - 40 if k >= 40 and (k - 40) % 7 <= 4 else k for k in range(80)}


def test_fingerprints_alone_find_copies(spark, monkeypatch):
    """What SimHash and covering masks link is dropped without any prefix, and sets decide on it."""
    rows = changed_copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    none = "a long, b long"
    monkeypatch.setattr(similar, "prefix_links", lambda *_: spark.createDataFrame([], none))
    kept = {r.doc_id for r in similar.drop_near(frame).collect()}
    prints = [similar.majority(similar.distinct_hashes(t.encode(), 5), range(100, 101))[0] for _, t in rows]
    within = {2 * k + 1 for k in range(30) if (prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= 4}
    assert len(within) > 15 and kept == {d for d, _ in rows} - within
    apart = spark.createDataFrame([(k, f"{k} one two three four five six") for k in range(4)], "doc_id long, text string")
    monkeypatch.setattr(similar, "majority", lambda hashes, numbers: [0] * len(numbers))
    assert similar.drop_near(apart).count() == 4


def test_linked_sets_are_not_compared_again(monkeypatch):
    rng = np.random.default_rng(1)
    sketches, sizes = rng.integers(0, 1 << 63, (9, similar.SKETCH)).astype(np.uint64), np.full(9, 50.0)
    sketches[4] = sketches[8]
    known = np.array([0, 0, 0, 3, 3, 3, 3, 7, 7])
    ends, roots = similar.linked(sketches, sizes, known, 0.4)
    assert [(int(a), int(b)) for a, b in zip(ends, roots, strict=True)] == [(8, 3)]
    compared = []
    plain = similar.similar
    monkeypatch.setattr(similar, "similar", lambda apart, *rest: compared.append(apart.size) or plain(apart, *rest))
    assert not len(similar.linked(sketches, sizes, np.zeros(9), 0.4)[0]) and not compared
