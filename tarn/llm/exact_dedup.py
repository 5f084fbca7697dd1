"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import ROW, Rows, Workspace, addressed, join_groups, map_rows, small_batches, texts_as_bytes

#: Identifier functions in the order they are tried; the next one is taken if one gives two chunks one identifier.
IDENTIFIERS: tuple[Callable[[bytes], bytes], ...] = (
    lambda chunk: xxhash.xxh3_128_digest(chunk),
    lambda chunk: hashlib.sha256(chunk).digest(),
)

LEAST, MEAN_BITS, MOST = 1024, 12, 16384
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20


def gear_table() -> np.ndarray:
    """256 fixed pseudo-random 32-bit words, from a SplitMix64 sequence."""
    state = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    state = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (state >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the (up to) 32 bytes that end there, by doubling."""
    hashes = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if step < len(hashes):
            before = hashes.copy()
            hashes[step:] += before[:-step] << np.uint32(step)
    return hashes


def marks(text: bytes) -> Iterator[int]:
    """Ends of the 32-byte strings at which a chunk may end, in order; hashed in blocks, so a long text takes no more memory."""
    data = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, len(data), BLOCK):
        first = max(0, at - 31)
        hashes = gear_hashes(data[first : at + BLOCK])[at - first :]
        yield from (np.flatnonzero(hashes >> np.uint32(32 - MEAN_BITS) == 0) + (at + 1)).tolist()


def cut_points(text: bytes) -> list[int]:
    """Ends of a text's chunks; where they fall depends on nearby content only."""
    if len(text) <= LEAST:
        return [len(text)]
    cuts, at, places = [], 0, marks(text)
    place = next(places, len(text))
    while len(text) - at > LEAST:
        while place < at + LEAST and place < len(text):
            place = next(places, len(text))
        at = min(place, at + MOST)
        cuts.append(at)
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return cuts


def chunks(text: bytes) -> Iterator[bytes]:
    at = 0
    for cut in cut_points(text):
        yield text[at:cut]
        at = cut


def chunk_table(texts: DataFrame, identify: Callable[[bytes], bytes]) -> DataFrame:
    """(identifier, chunk) of every document's chunks; a task sends a chunk it meets again once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in small_batches(batches):
            rows = []
            for text in texts_as_bytes(part.column(0)):
                for chunk in chunks(text.lower()):
                    name = identify(chunk)
                    key = name + xxhash.xxh64_digest(chunk)
                    if key in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(key)
                    rows.append((name, chunk))
            names, found = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(found, pa.binary())], ["identifier", "chunk"]
            )

    return map_rows(texts.select("text"), "identifier binary, chunk binary", work)


def recipe_table(texts: DataFrame, identify: Callable[[bytes], bytes]) -> DataFrame:
    """(row, doc_id, name, recipe, text_sha256): a recipe is the ordered list of a text's chunk identifiers, name a hash of it."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            folded = [x.lower() for x in texts_as_bytes(part.column(2))]
            recipes = [[identify(c) for c in chunks(x)] for x in folded]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([identify(b"".join(r)) for r in recipes], pa.binary()),
                    pa.array(recipes, pa.list_(pa.binary())),
                    pa.array([hashlib.sha256(x).hexdigest() for x in folded], pa.string()),
                ],
                ["row", "doc_id", "name", "recipe", "text_sha256"],
            )

    schema = f"row {ROW}, doc_id {id_type}, name binary, recipe array<binary>, text_sha256 string"
    return map_rows(texts.select("row", "doc_id", "text"), schema, work)


def recipe_groups(ws: Workspace, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): the rows with their recipes' names, and for each distinct recipe its name, best row and size.

    Taken with the first identifier function that gives no two different chunks
    and no two different recipes one name.  Chunks are deduplicated by their
    bytes, so each distinct chunk crosses the network about once per task that
    holds it; recipes are compared as lists.
    """
    for identify in IDENTIFIERS:
        distinct = chunk_table(texts, identify).groupBy("identifier", "chunk").agg(F.lit(1).alias("one"))
        if _repeated(distinct, "identifier"):
            continue
        rows = ws.table(recipe_table(texts, identify))
        groups = rows.groupBy("recipe").agg(
            F.first("name").alias("name"), F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")
        )
        groups = ws.table(groups.drop("recipe"))
        if not _repeated(groups, "name"):
            return rows.drop("recipe"), groups
    raise RuntimeError("every identifier function gave two different chunks or recipes one name")


def _repeated(frame: DataFrame, name: str) -> bool:
    return frame.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose texts are equal after lower-casing A-Z.

    Texts are cut where their content says so, equal chunks get one verified
    identifier, and two texts are equal if their ordered identifier lists are.
    Whole texts never travel; the chunk bytes do once, for verification.  Groups
    with a large part of all rows are broadcast, the others joined by name.

    Returns one row per input row: ``row`` (its address), ``doc_id``,
    ``keep_id`` (the largest id of its group), ``keep_row``, ``group_size``,
    ``kept`` and ``text_sha256``.  Null texts count as empty.  Null ids lose to
    any other id; a group of null ids alone has a null ``keep_id``.  Of rows
    that repeat text and id, ``keep_row`` names one, and ``kept`` is true for it
    alone.  Very long texts are hashed in blocks.  An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    return _groups(addressed(docs), id_col, text_col)


def _groups(rows: Rows, id_col: str, text_col: str) -> DataFrame:
    with Workspace(rows.docs.sparkSession) as ws:
        named, groups = recipe_groups(ws, rows.texts(id_col, text_col))
        return ws.deliver(
            join_groups(named, groups, "name", "group_size", named.count()).select(
                "row",
                "doc_id",
                F.col("best.doc_id").alias("keep_id"),
                F.col("best.row").alias("keep_row"),
                "group_size",
                (F.col("row") == F.col("best.row")).alias("kept"),
                "text_sha256",
            )
        )


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of equal texts (see ``exact_groups``: nulls, ties, repeats, long texts).

    All columns are kept, whatever their names; an empty table stays empty.
    """
    rows = addressed(docs)
    with Workspace(docs.sparkSession) as ws:
        _, groups = recipe_groups(ws, rows.texts(id_col, text_col))
        kept = ws.deliver(groups.select(F.col("best.row").alias("row")))
    return rows.keep(kept)
