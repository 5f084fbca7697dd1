"""Near copies: SimHash fingerprints linked through covering masks, prefixes for what lies beyond, and the shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import ROW, Rows, Workspace, addressed, join_groups, map_rows, small_batches, texts_as_bytes
from tarn.llm.components import connected_components
from tarn.llm.simhash import component_least, near_links, shingle_hashes, signed

#: 64-bit words of a set's SimHash sketch.
SKETCH = 8


def remixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """An independent 64-bit hash of each hash (SplitMix64 of it, moved by ``number``)."""
    x = hashes + np.uint64((number * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray, numbers: range) -> list[int]:
    """For each number the word whose bits are set in over half the hashes remixed with it."""
    ones = np.zeros(64 * len(numbers), dtype=np.int64)
    for at in range(0, len(hashes), 255):
        part = np.stack([remixed(hashes[at : at + 255], k) for k in numbers], axis=1).astype("<u8")
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8").tolist()


def distinct_hashes(text: bytes, words: int) -> np.ndarray:
    parts = [np.unique(h) for h in shingle_hashes(text, words, 42)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def similar(apart: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of sizes a and b, whose sketches differ in ``apart`` bits, have a Jaccard similarity of ``least``.

    Differing bits estimate the angle of the sets; with their sizes it gives the
    size of the intersection.
    """
    shared = np.cos(np.pi * apart / (64 * SKETCH)) * np.sqrt(a * b)
    return shared >= least * (a + b - shared) - 1e-9


def linked(sketches: np.ndarray, sizes: np.ndarray, known: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, first member) positions: links that make the components of 'similar' of those of equal ``known``.

    Members of equal ``known`` count as linked already and are not compared with each other.
    """
    left = np.arange(len(sizes))
    ends, roots = [], []
    while len(left):
        root, same = left[0], known[left] == known[left[0]]
        reached, left = left[same], left[~same]
        while len(reached) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for at in range(0, len(reached), 32):
                rest = np.flatnonzero(~near)
                some = reached[at : at + 32]
                apart = np.bitwise_count(sketches[some][:, None, :] ^ sketches[left[rest]][None, :, :]).sum(axis=2, dtype=np.int64)
                near[rest[similar(apart, sizes[some][:, None], sizes[left[rest]][None, :], least).any(axis=0)]] = True
            ends.append(left[near])
            roots.append(np.full(int(near.sum()), root))
            near |= np.isin(known[left], known[left[near]])
            reached, left = left[near], left[~near]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *ends]), np.concatenate([none, *roots])


def fingerprint_roots(ws: Workspace, nodes: DataFrame, radius: int, bucket_limit: int) -> DataFrame:
    """``nodes`` with the least node of each one's component of SimHash fingerprints at most ``radius`` bits apart as ``root``."""
    first = ws.table(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    roots = connected_components(ws, near_links(ws, first.select("fp"), radius, bucket_limit))
    classes = ws.table(component_least(ws, first, roots, "fp").select("fp", "n", F.col("least").alias("root")))
    return ws.table(join_groups(nodes, classes, "fp", "n", nodes.count()).drop("n"))


def bucket_links(rows: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): links of the nodes that share a key in ``rows`` (key, node), compared in memory.

    What their fingerprints have linked (``root``) is not compared, nor are buckets that hold nothing else.
    """
    members = F.collect_list(F.struct("node", "sketch", "size", "root")).alias("members")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            a, b = [], []
            for rows in batch.column(0).to_pylist():
                sketches = np.frombuffer(b"".join(r["sketch"] for r in rows), dtype="<u8").reshape(-1, SKETCH)
                sizes, known = np.array([r["size"] for r in rows], dtype=np.float64), np.array([r["root"] for r in rows])
                ends, roots = linked(sketches, sizes, known, least)
                a += [rows[k]["node"] for k in ends.tolist()]
                b += [rows[k]["node"] for k in roots.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    told = rows.join(nodes.select("node", "sketch", "size", "root"), "node")
    mixed = told.groupBy("key").agg(members, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return map_rows(mixed.select("members"), "a long, b long", link)


def bounded_buckets(met: DataFrame, limit: int) -> DataFrame:
    """(key, node): the buckets of ``met`` (key, node, n), those over ``limit`` members as pairs of blocks of them.

    Any two members of a bucket share a pair of blocks, which holds about
    ``limit`` members, so a crowded bucket is compared like any other.
    """
    blocks = F.ceil(2 * F.col("n") / limit)
    crowded = met.where(F.col("n") > limit).select(
        "key", "node", F.pmod(F.xxhash64("node", "key"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")
    )
    paired = crowded.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node")
    return met.where(F.col("n") <= limit).select("key", "node").unionAll(paired)


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set, rare ones first, of which any set with a Jaccard similarity of ``least`` shares one.

    Such sets share at least ``least`` of the larger one.  In one order of all
    shingles their first common one therefore stands no later in either than
    the part of it that may be missing, and one more.  Any order will do;
    ``common`` (ascending) with ``counts`` puts shingles of many texts last.
    """
    if not len(hashes):
        return hashes
    weight = np.zeros(len(hashes), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        weight = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, weight))[: len(hashes) - math.ceil(least * len(hashes) - 1e-9) + 1]]


def common_shingles(texts: DataFrame, shingle: int, rows: int = 4096, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles of several texts among about ``rows`` of (row, text): only an order, no result depends on it."""
    step = max(1, texts.count() // rows)
    some = texts.where(F.pmod(F.xxhash64("row"), F.lit(step).cast("long")) == 0).select("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            for text in texts_as_bytes(part.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(distinct_hashes(text, shingle).view(np.int64))], ["hash"])

    counted = map_rows(some, "hash long", work).groupBy("hash").agg(F.count("*").alias("n")).where("n > 2")
    found = counted.orderBy(F.desc("n"), "hash").limit(most).toArrow()
    hashes = found.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column(1).to_numpy().astype(np.int64)[order]


def set_name(hashes: np.ndarray, seed: int) -> tuple[int, int]:
    """(node, check): two 64-bit halves of a hash of a set; ``shingle_nodes`` sees to it that node alone tells sets apart."""
    name = xxhash.xxh3_128_intdigest(hashes.tobytes(), seed)
    return signed(name >> 64), signed(name & (1 << 64) - 1)


def shingle_rows(texts: DataFrame, shingle: int, least: float, seed: int) -> DataFrame:
    """(row, doc_id, node, check, fp, sketch, size, keys): a node is a set of shingles, its keys are its prefix.

    The first word of a set's SimHash sketch is its 64-bit fingerprint.
    """
    id_type = texts.schema["doc_id"].dataType.simpleString()
    common, counts = common_shingles(texts, shingle)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            nodes, prints, sketches, sizes, keys = [], [], [], [], []
            for text in texts_as_bytes(part.column(2)):
                hashes = distinct_hashes(text, shingle)
                nodes.append(set_name(hashes, seed))
                sketch = majority(hashes, range(100, 100 + SKETCH))
                prints.append(signed(sketch[0]))
                sketches.append(np.array(sketch, dtype="<u8").tobytes())
                sizes.append(len(hashes))
                keys.append(prefix(hashes, common, counts, least).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([n for n, _ in nodes], pa.int64()),
                    pa.array([c for _, c in nodes], pa.int64()),
                    pa.array(prints, pa.int64()),
                    pa.array(sketches, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "node", "check", "fp", "sketch", "size", "keys"],
            )

    schema = f"row {ROW}, doc_id {id_type}, node long, check long, fp long, sketch binary, size long, keys array<long>"
    return map_rows(texts.select("row", "doc_id", "text"), schema, work)


def shingle_nodes(ws: Workspace, texts: DataFrame, shingle: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): the rows of ``shingle_rows``, and one row a distinct set with its first text.

    A 64-bit name that two sets share, told by the other half of their 128-bit
    hash, has all named anew with another seed.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    for seed in range(8):
        rows = ws.table(shingle_rows(texts, shingle, least, seed))
        nodes = ws.table(
            rows.groupBy("node").agg(
                F.min(first).alias("first"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("size").alias("size"),
                (F.min("check") == F.max("check")).alias("sure"),
            )
        )
        if not nodes.where("not sure").limit(1).count():
            return rows, nodes.drop("sure")
    raise RuntimeError("every seed gave two different sets of shingles one name")


def prefix_links(ws: Workspace, rows: DataFrame, nodes: DataFrame, least: float, bucket_limit: int) -> DataFrame:
    """(a, b): links between nodes that share a shingle of their prefixes and have sketches of a similarity of ``least``."""
    dealt = rows.select("node", F.explode("keys").alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
    sizes = ws.table(sizes.where("low < high").select("key", "n"))
    met = dealt.join(sizes, "key").select("key", "node", "n").distinct()
    return bucket_links(bounded_buckets(met, bucket_limit), nodes, least).distinct()


def linked_sets(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, first member) positions: the components of 'Jaccard similarity of ``least`` or more', one link a member at most."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(known), dtype=np.int32)
    left = np.arange(1, len(sets))
    rest, root, queue = flat[starts[1] :], 0, [0]
    ends, roots = [], []
    while len(left):
        if not queue:
            root, queue = int(left[0]), [int(left[0])]
            rest, left = rest[sizes[root] :], left[1:]
            continue
        one = queue.pop()
        mine = flat[starts[one] : starts[one + 1]]
        marked[mine] = 1
        shared = np.add.reduceat(marked[rest], np.concatenate([[0], np.cumsum(sizes[left])[:-1]]))
        marked[mine] = 0
        near = shared >= least * (sizes[one] + sizes[left] - shared) - 1e-9
        if near.any():
            queue += left[near].tolist()
            ends.append(left[near])
            roots.append(np.full(int(near.sum()), root))
            rest, left = rest[np.repeat(~near, sizes[left])], left[~near]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *ends]), np.concatenate([none, *roots])


def verified_links(
    ws: Workspace, texts: DataFrame, nodes: DataFrame, roots: DataFrame, shingle: int, least: float, group_bytes: int
) -> DataFrame:
    """(a, b): links by the shingle sets themselves, within each group that ``roots`` (node, root) makes of the nodes.

    One text a node is read again.  Groups whose sets take more than
    ``group_bytes`` are compared in pairs of blocks of their members.
    """
    named = nodes.select("node", "size", F.col("first.row").alias("row")).join(roots, "node", "left")
    named = ws.table(named.withColumn("root", F.coalesce("root", "node")))
    groups = ws.table(named.groupBy("root").agg(F.count("*").alias("n"), F.sum(8 * F.col("size")).alias("bytes")).where("n > 1"))
    blocks = F.when(F.col("bytes") > group_bytes, F.ceil(2 * F.col("bytes") / group_bytes)).otherwise(1).cast("long")
    members = ws.table(join_groups(named, groups, "root", "n", named.count()).select("row", "node", "root", blocks.alias("blocks")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            sets = [distinct_hashes(t, shingle).tobytes() for t in texts_as_bytes(part.column(3))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], ["node", "root", "blocks", "hashes"])

    wanted = texts.select("row", "text").join(members.hint("shuffle_hash"), "row")
    sets = map_rows(wanted.select("node", "root", "blocks", "text"), "node long, root long, blocks long, hashes binary", work)
    own = F.pmod(F.xxhash64("node", "root"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = sets.select("node", "root", "hashes", own.alias("own"), other.alias("other"))
    dealt = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "hashes")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            ends, firsts = linked_sets([s for _, s in held], least)
            columns = [pa.array([held[k][0] for k in x.tolist()], pa.int64()) for x in (ends, firsts)]
            return pa.RecordBatch.from_arrays(columns, ["a", "b"])

        key, held = None, []
        for part in (p for batch in batches for p in small_batches([batch], 64)):
            for k, node, raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if k != key:
                    if len(held) > 1:
                        yield links(held)
                    key, held = k, []
                held.append((node, np.frombuffer(raw, dtype=np.uint64)))
        if len(held) > 1:
            yield links(held)

    return map_rows(dealt.repartition("key").sortWithinPartitions("key"), "a long, b long", link)


def near_classes(
    ws: Workspace, docs: Rows, shingle: int, similarity: float, radius: int, bucket_limit: int, group_bytes: int, id_col: str, text_col: str
) -> DataFrame:
    """(node, first, least): each distinct set of shingles with its first text and that of its group of near copies.

    Fingerprints link sets first; prefixes add what lies beyond their radius, and the sets decide on all of it.
    """
    texts = docs.texts(id_col, text_col)
    rows, nodes = shingle_nodes(ws, texts, shingle, similarity)
    nodes = fingerprint_roots(ws, nodes, radius, bucket_limit)
    near = nodes.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    loose = connected_components(ws, near.unionAll(prefix_links(ws, rows, nodes, similarity / 2, bucket_limit)))
    links = verified_links(ws, texts, nodes, loose, shingle, similarity, group_bytes)
    return component_least(ws, nodes.select("node", "first"), connected_components(ws, links), "node")


def drop_near(
    docs: DataFrame,
    *,
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 4,
    bucket_limit: int = 16384,
    group_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, one of each group of near copies; all columns are kept, whatever their names.

    Near copies have sets of ``shingle``-word shingles with a Jaccard similarity
    of ``similarity`` or more, by the sets themselves.  Candidates are sets whose
    SimHash fingerprints are at most ``radius`` bits apart, found through covering
    masks, and, as that similarity allows more bits, those beyond whose prefixes
    share a shingle, as all such sets do; of the latter sketches part what is far
    below, at half of it (some nine standard errors).  Groups are connected
    components; the row with the smallest id stays (null ids last; of rows that
    repeat it the first).  Texts without words, null ones too, are alike; a text
    of fewer words is one shingle; repeated rows are near copies; very long
    texts are hashed in blocks; an empty table stays empty.
    """
    rows = addressed(docs)
    with Workspace(docs.sparkSession) as ws:
        classes = near_classes(ws, rows, shingle, similarity, radius, bucket_limit, group_bytes, id_col, text_col)
        kept = ws.deliver(classes.where("first = least").select(F.col("least.row").alias("row")))
    return rows.keep(kept)
