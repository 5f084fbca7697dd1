import hashlib
import random

import numpy as np
import pytest
import xxhash

from tarn.llm import exact_dedup, simhash
from tarn.llm.common import Workspace
from tarn.llm.components import connected_components

SCHEMA = "doc_id long, text string, row string, recipe int"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "é"]) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = words(rng, 400)
    texts = [base, base.upper(), base.lower(), "", None, "   ", "one", "ONE", "two words", "a b c d", words(rng, 30000)]
    texts += [base.replace("alpha1 ", "omega ", 1), base + " tail", "É", "é"]
    texts += [words(rng, rng.randrange(1, 60)) for _ in range(30)]
    found = [(k, t, "x", k) for k, t in enumerate(texts)]
    return found + [(3, "", "y", 0), (None, "one", "z", 1), (None, None, None, None), (50, base, "w", 2), (50, base, "w", 2)]


def lower(text):
    return (text or "").encode().lower()


def test_chunks_rebuild_texts_and_follow_content():
    rng = random.Random(1)
    text = words(rng, 20000).encode()
    found = list(exact_dedup.chunks(text))
    assert b"".join(found) == text and len(found) > 5
    assert all(len(c) <= exact_dedup.MOST for c in found)
    moved = list(exact_dedup.chunks(b"some words before " + text))
    assert len(set(found) & set(moved)) >= len(found) - 3
    assert list(exact_dedup.chunks(b"")) == [b""]


def test_exact_groups_equal_brute_force(spark, rows):
    found = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    groups = {}
    for k, (doc, text, *_) in enumerate(rows):
        groups.setdefault(lower(text), []).append(doc)
    assert len(found) == len(rows)
    for r in found:
        text = next(t for t in groups if hashlib.sha256(t).hexdigest() == r.text_sha256)
        ids = [i for i in groups[text] if i is not None]
        assert r.group_size == len(groups[text]) and r.keep_id == max(ids, default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in found) == len(groups)


def test_identifier_collisions_take_the_next_function(spark, rows, monkeypatch):
    good = exact_dedup.IDENTIFIERS[-1]
    weak = lambda chunk: bytes([len(chunk) % 3])
    lists = lambda chunk: b"same" if len(chunk) % 32 == 0 else good(chunk)
    for bad in (weak, lists):
        monkeypatch.setattr(exact_dedup, "IDENTIFIERS", (bad, good))
        found = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA))
        assert sum(r.kept for r in found.collect()) == len({lower(t) for _, t, *_ in rows})


def test_long_texts_are_cut_alike_in_blocks(monkeypatch):
    text = words(random.Random(4), 40000).encode()
    whole = exact_dedup.cut_points(text)
    monkeypatch.setattr(exact_dedup, "BLOCK", 1000)
    assert exact_dedup.cut_points(text) == whole and whole[-1] == len(text)


def test_drop_exact_copies_keeps_columns(spark, rows):
    kept = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "row", "recipe"]
    assert sorted(map(lower, [r.text for r in kept.collect()])) == sorted({lower(t) for _, t, *_ in rows})


def brute_fingerprint(text):
    found = lower(text).split()
    shingles = [b" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_over_blocks(rows, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    for _, text, *_ in rows:
        data = (text or "").encode()
        blocks = [w for b in simhash.word_blocks(data, 50) for w in b]
        assert blocks == data.split()
        assert simhash.fingerprint(data) == brute_fingerprint(text)


def test_masks_cover_every_pair():
    rng = random.Random(3)
    for radius in (1, 2, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            difference = sum(1 << i for i in rng.sample(range(64), radius))
            assert any(not difference & m for m in masks)


def brute_components(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in root}


@pytest.mark.parametrize("limit", [10000, 3])
@pytest.mark.parametrize("radius", [3, 4])
def test_links_give_all_components(spark, limit, radius):
    rng = random.Random(radius)
    values = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(150):
        values.append(rng.choice(values) ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 8))))
    distinct = spark.createDataFrame([(simhash.signed(v),) for v in set(values)], "fp long")
    with Workspace(spark) as ws:
        links = simhash.near_links(ws, distinct, radius, limit)
        roots = {r.node: r.root for r in connected_components(ws, links).collect()}
    expected = brute_components(set(values), radius)
    same = {}
    for v in set(values):
        s = simhash.signed(v)
        same.setdefault(expected[v], set()).add(roots.get(s, s))
    assert all(len(x) == 1 for x in same.values())
    assert len({next(iter(x)) for x in same.values()}) == len(same) > 10


def test_near_groups_equal_brute_force(spark, rows):
    found = simhash.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    classes = brute_components(set(prints), 4)
    least = {}
    for (doc, *_), p in zip(rows, prints, strict=True):
        least.setdefault(classes[p], []).append(doc)
    expected = sorted(
        (str(doc), simhash.signed(p), str(min((d for d in least[classes[p]] if d is not None), default=None)))
        for (doc, *_), p in zip(rows, prints, strict=True)
    )
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in found) == expected
    assert sum(r.row == r.component_row for r in found) == len(least)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0
    assert simhash.drop_near_copies(empty).columns == empty.columns


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(5, k) for k in range(200, 260)] + [(7, 7), (141, 300)]
    with Workspace(spark) as ws:
        found = {r.node: r.root for r in connected_components(ws, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 100 for k in range(101, 141)) and all(found[k] == 5 for k in range(200, 260))
    assert found[300] == 141 and 7 not in found


def test_spanning_links_blocks():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    members = np.array([centre ^ np.uint64((1 << a) | (1 << b)) for a in range(64) for b in range(a)])
    ends, roots = simhash.spanning_links(members, 4)
    assert len(ends) == len(set(members.tolist())) - 1 and len(set(roots.tolist())) == 1


def test_columns_that_clash(spark, rows):
    schema = "doc_id long, text string, TEXT string, row string, recipe int, __row int, fp string"
    frame = spark.createDataFrame([(d, t, "no", "r", 1, 2, "f") for d, t, *_ in rows], schema)
    for drop in (exact_dedup.drop_exact_copies, simhash.drop_near_copies):
        kept = drop(frame)
        assert kept.columns == frame.columns and 0 < kept.count() < frame.count()
    assert sorted(map(lower, [r[1] for r in exact_dedup.drop_exact_copies(frame).collect()])) == sorted({lower(t) for _, t, *_ in rows})
