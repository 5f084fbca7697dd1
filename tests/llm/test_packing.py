import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarn.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(11)
    pick = lambda n: "".join(rng.choice("ab c,.\n 1é漢🙂's") for _ in range(n))
    marked = lambda n: "".join(rng.choice(["<|endoftext|>", " ", "a", "\n", "<|", "|>", "x y"]) for _ in range(n))
    more = [marked(rng.randrange(1, 200)) for _ in range(20)]
    return [*more, "", None, "plain words here", "<|endoftext|>", "a <|endoftext|> b", "x  <|endoftext|>\n<|endoftext|><|endoftext|>  <|endoftext", "a" * 9000, " " * 7000, pick(20000)] + [
        pick(rng.randrange(1, 3000)) for _ in range(80)
    ]


def test_ids_equal_the_tokenizer(plain):
    for text in texts():
        ids = packing.encode(PATH, text or "", 0)
        assert ids.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 0]


def test_parts_do_not_change_ids(plain):
    for text in filter(None, texts()):
        cut = list(packing.parts(text, 100))
        assert "".join(cut) == text
        assert [i for p in cut for i in plain.encode(p, add_special_tokens=False).ids] == plain.encode(
            text, add_special_tokens=False
        ).ids


def test_long_white_space(plain):
    text = "x" + " " * 600_000 + "y"
    assert len(packing.encode(PATH, text, 0)) > 1000


def test_best_fit_decreasing_equals_a_plain_search():
    rng = random.Random(4)
    for window in (1, 7, 64, 1024):
        lengths = [rng.randint(1, window) for _ in range(300)]
        placed = packing.best_fit_decreasing(lengths, window)
        room = []
        for length in sorted(lengths, reverse=True):
            fits = [c for c in room if c >= length]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else window) - length)
        assert max(w for w, _ in placed) + 1 == len(room)
        used = {}
        for (w, at), length in sorted(zip(placed, lengths, strict=True)):
            assert at == used.get(w, 0)
            used[w] = at + length
        assert max(used.values()) <= window
        assert sorted(window - u for u in used.values()) == sorted(room)


def test_pieces_rebuild_documents(spark, plain):
    rows = [(k, t, 1) for k, t in enumerate(texts())] + [(None, "x", 2), (3, "again", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    pieces = packing.pack_documents(frame, PATH, window=256, shard_pieces=20).collect()
    found, used = {}, {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert len(p.ids) == 4 * p.length and p.offset == used.get(p.sequence_id, 0)
        used[p.sequence_id] = p.offset + p.length
        found.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    assert max(used.values()) <= 256
    rebuilt = sorted(
        str((doc, np.frombuffer(b"".join(p.ids for p in sorted(ps, key=lambda p: p.start)), "<u4").tolist()))
        for (doc, _), ps in found.items()
    )
    assert rebuilt == sorted(
        str((d, [*plain.encode(t or "", add_special_tokens=False).ids, 0])) for d, t, _ in rows
    )
    assert sum(used.values()) / (256 * len(used)) > 0.8
    assert packing.pack_documents(frame.limit(0), PATH).count() == 0


def test_other_files_are_run_by_their_own_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    for text in ("Plain words", "a <|endoftext|> b", ""):
        assert packing.encode(path, text, 0).tolist() == [*other.encode(text, add_special_tokens=False).ids, 0]


def test_query_equals_the_tokenizer(spark, plain, tmp_path):
    """The registered query itself, its digests included, against the tokenizer's own ids."""
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for p in queries.op6_packing(spark, str(tmp_path)).collect():
        found.setdefault(p.doc_id, []).append(p)
    assert len(found) == len(rows)
    used = {}
    for doc, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(found[doc], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            used.setdefault(p.sequence_id, []).append((p.offset, p.length))
            at += p.length
        assert at == len(ids)
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_small_lots_pack_nearly_as_well_as_one(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["word"] * rng.randrange(1, 240))) for k in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    used = [packing.pack_documents(frame, PATH, window=256, shard_pieces=n).select("sequence_id").distinct().count() for n in (100000, 400)]
    assert used[1] <= 1.02 * used[0]
