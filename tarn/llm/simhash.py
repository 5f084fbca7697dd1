"""Near-duplicate detection: SimHash fingerprints linked through covering masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import ROW, Rows, Workspace, addressed, join_groups, map_rows, small_batches, texts_as_bytes
from tarn.llm.components import connected_components

BITS = 64
SPACE = b" \t\n\v\f\r"
#: Bytes of text that are split into words at once.
BLOCK = 1 << 20


def word_blocks(text: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """A text's words in order, in lists of bounded size."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and text[cut] not in SPACE:
            cut += 1
        yield text[at:cut].split()
        at = cut
    yield text[at:].split()


def shingle_hashes(text: bytes, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of ``words`` lower-cased words; a shorter text is one shingle."""
    carried: list[bytes] = []
    made = False
    for block in word_blocks(text.lower()):
        block = carried + block
        if len(block) >= words:
            joined = b" ".join(block)
            ends = np.cumsum([len(w) + 1 for w in block])
            starts = np.concatenate([[0], ends[:-1]])[: len(block) - words + 1].tolist()
            digest = xxhash.xxh64_intdigest
            made = True
            yield np.array(
                [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)],
                dtype=np.uint64,
            )
            block = block[len(block) - words + 1 :]
        carried = block
    if not made and carried:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), seed)], dtype=np.uint64)


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash; bit i is set if it is in over half the shingle hashes, repeats counted."""
    ones, total = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text, words, seed):
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)].astype("<u8")
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(((2 * ones > total).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks such that any two words within ``radius`` bits agree under some mask.

    Bit i gets a vector f(i) of radius+1 bits, all vectors but zero used equally
    often.  Mask v keeps the bits with an odd inner product f(i).v.  The at most
    ``radius`` vectors of the differing bits span less than the whole space, so
    some v is orthogonal to them all and its mask hides every difference.
    """
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(BITS)]
    return [
        sum(1 << i for i, f in enumerate(vectors) if (f & v).bit_count() % 2) for v in range(1, size)
    ]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def spanning_links(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that give a bucket the components of 'at most ``radius`` bits apart', one per member at most."""
    left = np.unique(members)
    ends, roots = [], []
    while len(left):
        root, reached, left = left[0], left[:1], left[1:]
        while len(reached) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for at in range(0, len(reached), 64):
                rest = np.flatnonzero(~near)
                apart = np.bitwise_count(reached[at : at + 64, None] ^ left[None, rest])
                near[rest[(apart <= radius).any(axis=0)]] = True
            reached, left = left[near], left[~near]
            ends.append(reached)
            roots.append(np.full(len(reached), root))
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate([empty, *ends]), np.concatenate([empty, *roots])


def half_ball(value: int, radius: int) -> np.ndarray:
    """All words within ``radius`` // 2 bits of a word (and one more bit if ``radius`` is odd)."""
    flips = [np.uint64(0)]
    reach = (radius + 1) // 2
    layer = {0: -1}
    for _ in range(reach):
        layer = {m | 1 << i: i for m, last in layer.items() for i in range(last + 1, BITS)}
        flips += [np.uint64(m) for m in layer]
    return np.array(flips, dtype=np.uint64) ^ np.uint64(value)


def fingerprints(texts: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(row, doc_id, fp): each text's fingerprint as a signed long; texts without words have zero."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            found = [signed(fingerprint(x, shingle, seed)) for x in texts_as_bytes(part.column(2))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(found, pa.int64())], ["row", "doc_id", "fp"]
            )

    return map_rows(texts.select("row", "doc_id", "text"), f"row {ROW}, doc_id {id_type}, fp long", work)


def near_links(ws: Workspace, distinct: DataFrame, radius: int, bucket_limit: int) -> DataFrame:
    """(a, b): links whose components are those of fingerprints at most ``radius`` bits apart.

    Fingerprints that agree under a covering mask meet in a bucket, which is
    compared in memory up to ``bucket_limit`` members.  Members of larger buckets
    are dealt out by every word within half the radius instead: two words within
    the radius share one, all that share one are within it, and no more than the
    ball's size can share it, so a link of each to the least of them is exact.
    """
    masks = covering_masks(radius)
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(masks)))
    dealt = distinct.select("fp", F.explode(keys).alias("key"))
    sizes = ws.table(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    joined = dealt.join(sizes, "key")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values = lists.values.to_numpy().astype(np.int64).view(np.uint64)
            offsets = lists.offsets.to_numpy()
            found = [
                spanning_links(values[a:b], radius) for a, b in zip(offsets[:-1], offsets[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, np.uint64), *(x[k] for x in found)]).view(np.int64))
                    for k in (0, 1)
                ],
                ["a", "b"],
            )

    buckets = joined.where(F.col("n") <= bucket_limit).groupBy("key").agg(F.collect_list("fp").alias("members"))
    links = map_rows(buckets.select("members"), "a long, b long", link)
    crowded = joined.where(F.col("n") > bucket_limit)
    if not sizes.where(F.col("n") > bucket_limit).limit(1).count():
        return links.distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = half_ball(0, radius)
        for batch in batches:
            values = batch.column(0).to_numpy().astype(np.int64)
            for value in values:
                yield pa.RecordBatch.from_arrays(
                    [pa.array((ball ^ value.view(np.uint64)).view(np.int64)), pa.array(np.full(len(ball), value))],
                    ["word", "fp"],
                )

    shared = map_rows(crowded.select("fp").distinct(), "word long, fp long", spread)
    stars = shared.groupBy("word").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    if radius % 2 == 0:
        found = stars.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where("a <> b")
    else:
        found = map_rows(stars.select("members"), "a long, b long", link)
    return links.unionAll(found).distinct()


def near_groups(
    docs: DataFrame,
    *,
    shingle: int = 4,
    radius: int = 4,
    seed: int = 42,
    bucket_limit: int = 16384,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Components of documents whose fingerprints differ in at most ``radius`` bits.

    Equal fingerprints are one node, so a group of copies of any size costs one
    comparison.  Only fingerprints and ids are shuffled.

    Returns one row per input row: ``row`` (its address), ``doc_id``, ``fp`` (signed long), ``component_id`` (the
    smallest non-null id reachable; null only if all are null) and
    ``component_row`` (the one row that stands for the component: of its rows
    with that id the first).  Null, empty and blank texts have fingerprint zero
    and are linked like any other.  Repeated rows are members like others; very
    long texts are hashed in blocks of words; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    return _groups(addressed(docs), shingle, radius, seed, bucket_limit, id_col, text_col)


def component_least(ws: Workspace, nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """The table ``nodes`` (``node``, first, ...) with the least ``first`` of each node's component as ``least``."""
    named = ws.table(nodes.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node)))
    least = named.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("nodes"))
    return join_groups(named, least, "root", "nodes", named.count())


def _groups(
    docs: Rows, shingle: int, radius: int, seed: int, bucket_limit: int, id_col: str, text_col: str
) -> DataFrame:
    with Workspace(docs.docs.sparkSession) as ws:
        rows = ws.table(fingerprints(docs.texts(id_col, text_col), shingle, seed))
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        distinct = ws.table(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")))
        roots = connected_components(ws, near_links(ws, distinct.select("fp"), radius, bucket_limit))
        classes = ws.table(component_least(ws, distinct, roots, "fp").select("fp", "n", "least"))
        return ws.deliver(
            join_groups(rows, classes, "fp", "n", rows.count()).select(
                "row",
                "doc_id",
                "fp",
                F.col("least.doc_id").alias("component_id"),
                F.col("least.row").alias("component_row"),
            )
        )


def drop_near_copies(
    docs: DataFrame, *, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, one of each component (see ``near_groups``: nulls, ties, repeats, long texts).

    All columns are kept, whatever their names; an empty table stays empty.
    """
    rows = addressed(docs)
    groups = _groups(rows, shingle, radius, 42, 16384, id_col, text_col)
    return rows.keep(groups.where("row = component_row"))
