"""The pipeline's near copies: what no estimate and no bucket may lose."""

import random

import numpy as np
import pytest

from tarn.llm import similar


def words(rng, count):
    return [f"w{rng.randrange(10**6)}" for _ in range(count)]


def test_crowded_buckets_compare_the_same_pairs(spark):
    """One bucket, whatever its size limit: any two of its members meet."""
    met = spark.range(12).selectExpr("1L AS key", "id AS node", "12L AS n")
    for limit in (100, 4, 2):
        together = {}
        for r in similar.bounded_buckets(met, limit).collect():
            together.setdefault(r.key, set()).add(r.node)
        pairs = {(a, b) for group in together.values() for a in group for b in group if a < b}
        assert len(pairs) == 66, limit


def hashed(text, shingle=5):
    return set(similar.distinct_hashes(text.encode(), shingle).tolist())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(rng, base, share, how):
    count = int(len(base) * share)
    if how == "append":
        return base + words(rng, count)
    if how == "truncate":
        return base[: len(base) - count]
    at = rng.randrange(len(base))
    return base[:at] + words(rng, count) + base[at:]


def test_passages_added_or_cut_are_found(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        base = words(rng, rng.choice([100, 300, 1000]))
        copy = changed(rng, base, 0.1, ("append", "truncate", "insert")[k % 3])
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    kept = {r.doc_id for r in similar.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(60):
        assert 2 * k in kept
        if jaccard(hashed(rows[2 * k][1]), hashed(rows[2 * k + 1][1])) > 0.87:
            assert 2 * k + 1 not in kept, k


def test_prefixes_share_a_shingle():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    common = np.sort(pool[:150])
    counts = rng.integers(3, 90, 150)
    for _ in range(2000):
        a = np.unique(rng.choice(pool, rng.integers(1, 60)))
        b = np.unique(np.concatenate([rng.choice(a, rng.integers(max(1, len(a) * 4 // 5), len(a) + 1), replace=False), rng.choice(pool, rng.integers(0, 4))]))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(*(similar.prefix(x, common, counts, 0.8) for x in (a, b))))


def brute_rows(rows, least=0.8):
    """The (id, text) rows that stay, by the true similarity of all pairs of texts."""
    sets = [hashed(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if jaccard(a, b) >= least - 1e-12:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    best = {}
    for k, (d, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), (True, d or 0, k)), (d is None, d or 0, k))
    return [rows[k] for k in sorted(b[2] for b in best.values())]


def brute_kept(rows):
    return sorted(str(d) for d, _ in brute_rows(rows))


@pytest.mark.parametrize(("limit", "group"), [(16384, 16 << 20), (2, 2000)])
def test_equals_true_similarity(spark, limit, group):
    rng = random.Random(9)
    rows = [(100000, None), (100001, ""), (100002, " \n"), (100003, "one word"), (100003, "One  word"), (None, "one word")]
    near = 0
    for k in range(150):
        base = words(rng, rng.choice([9, 40, 200, 400]))
        rows.append((3 * k, " ".join(base)))
        for n in (1, 2):
            copy = base[:]
            if k % 4 == 3:
                for _ in range(round(len(base) * rng.uniform(0.018, 0.03))):
                    copy[rng.randrange(len(copy))] = "x" + words(rng, 1)[0]
            else:
                copy = changed(rng, base, rng.uniform(0.12, 0.27), ("append", "truncate", "insert")[k % 3])
            rows.append((3 * k + n, " ".join(copy)))
            near += 0.75 <= jaccard(hashed(rows[-1][1]), hashed(" ".join(base))) < 0.85
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = similar.drop_near(frame, bucket_limit=limit, group_bytes=group)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == brute_kept(rows)
    assert near > 80 and similar.drop_near(frame.limit(0)).count() == 0
