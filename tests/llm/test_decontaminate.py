import random
import re

import numpy as np
import pytest

from tarn.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=13):
    phrases = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for p, owners in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= {str(o) for o in owners if o is not None}
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    vocabulary = ["The", "cat", "naïve", "é", "3", "x9", "dog", "ÀB", "run", "of"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randrange(0, 30))) for k in range(12)] + [(None, text(20)), (3, None), (4, text(5)), (4, text(5))]
    docs = [(k, text(rng.randrange(0, 60))) for k in range(60)]
    for k in range(60, 100):
        chosen = rng.choice(items)[1] or ""
        docs.append((k, f"{text(5)} {chosen} {text(rng.randrange(30))} {chosen[: rng.randrange(80)]} {chosen}"))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, items[1][1]), (102, items[1][1])]
    docs.append((103, " ".join([items[2][1] or "x"] * 200)))
    return docs, items


@pytest.mark.parametrize(("blocks", "lot"), [(8 << 20, D.LOT), (200, 7)])
def test_equals_brute_force(spark, tables, blocks, lot, monkeypatch):
    monkeypatch.setattr(D, "LOT", lot)
    docs, items = tables
    found = D.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        block_bytes=blocks,
        shard_bytes=3000,
    ).withColumn("hit", D.hit_words())
    got = sorted(((r.doc_id, r.n_words, r.hit, tuple(r["items"])) for r in found.collect()), key=str)
    assert got == brute(docs, items)
    assert sum(h > 0 for _, _, h, _ in got) > 20 and sum(h == 0 for _, _, h, _ in got) > 3


@pytest.mark.parametrize("blocks", [8 << 20, 200])
def test_drop(spark, tables, blocks):
    docs, items = tables
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, spans int")
    kept = D.drop_contaminated(
        frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=blocks, shard_bytes=3000
    )
    assert kept.columns == frame.columns
    clean = [d for d, n, h, _ in brute(docs, items) if h == 0 or 20 * h < n]
    assert sorted(map(str, clean)) == sorted(str(r.doc_id) for r in kept.collect())


def test_empty_tables(spark, tables):
    docs, items = tables
    no_docs = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert D.contamination(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert D.contamination(frame, no_items).where("size(spans) > 0").count() == 0
    assert D.drop_contaminated(frame, no_items).count() == len(docs)


def test_suffix_order_and_locate():
    rng = np.random.default_rng(2)
    runs = [rng.integers(1, 4, size=n) for n in (1, 5, 40, 40, 3)] + [np.ones(70, dtype=np.int64)] * 2
    index = D.FMIndex(runs, 3)
    phrase = np.array([[1, 1, 1], [0, 2, 3], [3, 3, 3], [0, 0, 2]])
    lengths = np.array([3, 2, 3, 1])
    low, high = index.search(phrase, lengths)
    starts = np.cumsum([0] + [len(r) + 1 for r in runs])
    for k in range(4):
        wanted = phrase[k, 3 - lengths[k] :].tolist()
        expected = sorted(
            int(s) + i
            for s, r in zip(starts, runs, strict=False)
            for i in range(len(r) - len(wanted) + 1)
            if r[i : i + len(wanted)].tolist() == wanted
        )
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == expected


def test_long_text_and_lots(monkeypatch):
    """Spans and items do not depend on how many occurrences are located at once."""
    rng = random.Random(8)
    items = [(str(k), " ".join(rng.choice("ab") for _ in range(rng.choice([2, 5, 13, 20]))).encode()) for k in range(12)] * 2
    texts = [" ".join(rng.choice("abc") for _ in range(n)).encode() for n in (0, 1, 30, 200, 5000)]
    phrases = D.Phrases(items, 13)
    whole = phrases.hits(texts)
    wanted = brute([(k, t.decode()) for k, t in enumerate(texts)], [(k, t.decode()) for k, t in items])
    assert [(k, n, sum(b - a for a, b in spans), tuple(found)) for k, (n, spans, found) in enumerate(whole)] == wanted
    monkeypatch.setattr(D, "LOT", 11)
    assert phrases.hits(texts) == whole


def test_copies_of_an_item_are_one(spark):
    items = spark.createDataFrame([(1, "a b c")] * 500 + [(2, "d")], "item_id long, text string")
    blocks = list(D.benchmark_blocks(items, "item_id", "text", 12))
    assert sorted(i for b in blocks for i in b) == [("1", b"a b c"), ("2", b"d")]


def test_very_long_text():
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(20)]
    words = [f"w{rng.randrange(5000)}" for _ in range(400_000)]
    words[123_456:123_456] = passage
    phrases = D.Phrases([("7", " ".join(passage).encode()), ("8", b"w1 " * 30)], 13)
    ((count, spans, items),) = phrases.hits([" ".join(words).encode()])
    assert (count, spans, items) == (400_020, [(123_456, 123_476)], ["7"])


def test_columns_that_clash(spark, tables):
    docs, items = tables
    schema = "doc_id long, text string, TEXT string, row string, items string, c1 int"
    frame = spark.createDataFrame([(*d, "no", "r", "i", 3) for d in docs], schema)
    kept = D.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=200)
    assert kept.columns == frame.columns
    clean = [d for d, n, h, _ in brute(docs, items) if h == 0 or 20 * h < n]
    assert sorted(map(str, clean)) == sorted(str(r[0]) for r in kept.collect())
