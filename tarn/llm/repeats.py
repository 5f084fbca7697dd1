"""Repeated substrings: windows of a threshold length, dealt by minimisers and ordered by radix passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import ROW, Workspace, addressed, join_groups, map_rows, small_batches, texts_as_bytes

#: Bytes of the gram whose hash picks a window's anchor.
GRAM = 32
#: Bytes of text that are hashed at once; positions in it take the low bits of a key.
BUFFER = 1 << 18
POSITION_BITS = 20

#: A name for a stretch of bytes, and one for a window.
Namer = Callable[[bytes], int]
Digest = Callable[[bytes], bytes]


def _seeded(seed: int) -> tuple[Namer, Digest]:
    return (lambda stretch: xxhash.xxh3_64_intdigest(stretch, seed)), (lambda window: xxhash.xxh3_128_digest(window, seed))


#: Naming functions in the order they are tried; the next ones are taken if two different strings got one name.
NAMERS: tuple[tuple[Namer, Digest], ...] = tuple(map(_seeded, range(6)))
#: Strings that a task remembers to send each but once.
SEEN = 100_000


def byte_table() -> np.ndarray:
    """256 fixed pseudo-random 64-bit words, from a SplitMix64 sequence."""
    state = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    state = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return state ^ (state >> np.uint64(31))


TABLE = byte_table()
FACTOR = 0x9E3779B97F4A7C15 | 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at each place, by doubling."""
    hashes, width = TABLE[data], 1
    while width < GRAM:
        factor = np.uint64(pow(FACTOR, width, 1 << 64))
        hashes = hashes[:-width] * factor + hashes[width:]
        width *= 2
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each run of ``width`` keys, by doubling."""
    least, reach = keys, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


class Supermers:
    """The windows of a list of texts, grouped into runs that share an anchor.

    A window's anchor is the leftmost gram of least hash in it, so equal windows
    have equal grams at equal places.  A run of windows with one anchor is one
    stretch of text.  Arrays: ``doc``, ``start`` (in the text), ``count`` (of
    windows), ``lead`` (anchor minus start), ``gram`` (the anchor's hash) and
    ``name`` (hash of the stretch by the given function).  Gram and name together
    name a stretch; whoever relies on it compares the bytes.
    """

    def __init__(self, texts: list[bytes], length: int, name: Namer):
        found: list[tuple] = []
        names: list[int] = []
        held, size = [], 0
        for piece in self._pieces(texts, length):
            if size and size + len(piece[2]) > BUFFER:
                self._scan(held, length, name, found, names)
                held, size = [], 0
            held.append(piece)
            size += len(piece[2])
        if held:
            self._scan(held, length, name, found, names)
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
        self.doc, self.start, self.count, self.lead, self.gram = columns
        self.name = np.array(names, dtype=np.uint64)

    #: Pieces of a long text overlap in bytes, so that each window is in exactly one of them.
    @staticmethod
    def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
        for doc, text in enumerate(texts):
            if len(text) <= BUFFER:
                if len(text) >= length:
                    yield doc, 0, text
            else:
                for at in range(0, len(text) - length + 1, BUFFER - length):
                    yield doc, at, text[at : at + BUFFER - 1]

    @staticmethod
    def _scan(pieces: list[tuple[int, int, bytes]], length: int, name: Namer, found: list[tuple], names: list[int]) -> None:
        joined = b"".join(p[2] for p in pieces)
        sizes = np.array([len(p[2]) for p in pieces], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        hashes = gram_hashes(np.frombuffer(joined, dtype=np.uint8))
        low = np.uint64((1 << POSITION_BITS) - 1)
        keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (window_minima(keys, length - GRAM + 1) & low).astype(np.int64)
        piece = np.repeat(np.arange(len(pieces)), np.maximum(sizes - length + 1, 0))
        offset = np.arange(len(piece)) - np.repeat(
            np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0), np.maximum(sizes - length + 1, 0)
        )
        place = begin[piece] + offset
        picked = anchor[place]
        heads = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (piece[1:] != piece[:-1])]))
        count = np.diff(np.append(heads, len(place)))
        at = place[heads]
        docs = np.array([p[0] for p in pieces], dtype=np.int64)[piece[heads]]
        bases = np.array([p[1] for p in pieces], dtype=np.int64)[piece[heads]]
        found.append((docs, bases + offset[heads], count, picked[heads] - at, hashes[picked[heads]]))
        names.extend(
            name(joined[a:b]) for a, b in zip(at.tolist(), (at + count + length - 1).tolist(), strict=True)
        )


def refine(classes: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """One pass of a most-significant-digit radix sort: classes split by the next byte, renumbered."""
    _, inverse = np.unique(classes * 256 + digit, return_inverse=True)
    return inverse.astype(np.int64)


def repeated_windows(
    groups: np.ndarray, stretches: list[bytes], leads: np.ndarray, counts: np.ndarray, times: np.ndarray, length: int
) -> np.ndarray:
    """For each stretch and each place 0..length-GRAM of the anchor in a window: is that window repeated?

    Stretches with one group number have the same hash of their anchor grams.
    The windows with the anchor at one place are equal if they agree on the
    anchor's bytes, those before it and those after it.  After a pass over the
    anchors radix passes order the stretches byte by byte outwards from the
    anchor, to the right and then to the left, no deeper than a window reaches;
    windows in one final class of both orders are equal.
    """
    n, reach = len(stretches), length - GRAM
    right = np.zeros((n, reach), dtype=np.uint8)
    left = np.zeros((n, reach), dtype=np.uint8)
    for k, (stretch, lead) in enumerate(zip(stretches, leads.tolist(), strict=True)):
        after = np.frombuffer(stretch, np.uint8, offset=lead + GRAM)
        right[k, : len(after)] = after
        left[k, :lead] = np.frombuffer(stretch, np.uint8, count=lead)[::-1]
    anchors = np.frombuffer(b"".join(s[k : k + GRAM] for s, k in zip(stretches, leads.tolist(), strict=True)), f"V{GRAM}")
    _, start = np.unique(groups, return_inverse=True)
    _, start = np.unique(start * n + np.unique(anchors, return_inverse=True)[1], return_inverse=True)
    rights = np.empty((reach + 1, n), dtype=np.int32)
    classes = start.astype(np.int64)
    rights[0] = classes
    for depth in range(reach):
        classes = refine(classes, right[:, depth])
        rights[depth + 1] = classes
    out = np.zeros((n, reach + 1), dtype=bool)
    classes = start.astype(np.int64)
    for place in range(reach + 1):
        if place:
            classes = refine(classes, left[:, place - 1])
        there = np.flatnonzero((leads >= place) & (leads - counts < place))
        if len(there):
            both = classes[there] * n + rights[reach - place][there]
            _, inverse = np.unique(both, return_inverse=True)
            out[there, place] = np.bincount(inverse, times[there])[inverse] > 1
    return out


def runs_of(flags: np.ndarray) -> list[int]:
    """Ends of the runs of true flags as [first, last, first, last, ...]."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    edges[1::2] -= 1
    return edges.tolist()


def to_signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def supermer_table(texts: DataFrame, length: int, name: Namer) -> DataFrame:
    """(gram, name, n, rows): each distinct stretch of a batch of texts, its count and the rows that hold it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches, 2048):
            found = Supermers(texts_as_bytes(part.column(1)), length, name)
            if not len(found.doc):
                continue
            order = np.lexsort((found.doc, found.name, found.gram))
            gram, names, doc = found.gram[order], found.name[order], found.doc[order]
            fresh = np.concatenate([[True], (gram[1:] != gram[:-1]) | (names[1:] != names[:-1])])
            heads = np.flatnonzero(fresh)
            first = fresh | np.concatenate([[True], doc[1:] != doc[:-1]])
            held = np.flatnonzero(first)
            offsets = np.append(np.searchsorted(held, heads), len(held)).astype(np.int32)
            rows = part.column(0).take(pa.array(doc[held]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(to_signed(gram[heads])),
                    pa.array(to_signed(names[heads])),
                    pa.array(np.diff(np.append(heads, len(gram)))),
                    pa.ListArray.from_arrays(pa.array(offsets), rows),
                ],
                ["gram", "name", "n", "rows"],
            )

    return map_rows(texts.select("row", "text"), f"gram long, name long, n long, rows array<{ROW}>", work)


def packed_texts(texts: DataFrame) -> DataFrame:
    """(row, doc_id, packed): texts compressed one by one, as they are shuffled more than once."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for part in small_batches(batches):
            packed = [compress(t) for t in texts_as_bytes(part.column(2))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(packed, pa.binary())], ["row", "doc_id", "packed"]
            )

    return map_rows(texts.select("row", "doc_id", "text"), f"row {ROW}, doc_id {id_type}, packed binary", work)


def unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def compared_stretches(texts: DataFrame, wanted: DataFrame, length: int, name: Namer) -> DataFrame:
    """(gram, name, n, lead, count, stretch): the bytes of the wanted stretches, from the row that stands for each."""
    asked = wanted.groupBy(F.struct("file", "at").alias("row")).agg(
        F.collect_list(F.struct("gram", "name", "n")).alias("asked")
    )
    joined = texts.select("row", "packed").join(asked.hint("shuffle_hash"), "row").select("packed", "asked")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for part in small_batches(batches, 256, 4 << 20):
            asked_for = part.column(1).to_pylist()
            texts = [unpack(p) for p in part.column(0).to_pylist()]
            all_of = Supermers(texts, length, name)
            grams, names = to_signed(all_of.gram).tolist(), to_signed(all_of.name).tolist()
            where: dict[tuple, int] = {}
            for k, key in enumerate(zip(all_of.doc.tolist(), grams, names, strict=True)):
                where.setdefault(key, k)
            rows = []
            for doc, items in enumerate(asked_for):
                for item in items:
                    k = where[doc, item["gram"], item["name"]]
                    start, count = int(all_of.start[k]), int(all_of.count[k])
                    rows.append(
                        (item["gram"], item["name"], item["n"], int(all_of.lead[k]), count, texts[doc][start : start + count + length - 1])
                    )
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["gram", "name", "n", "lead", "count", "stretch"],
            )

    return map_rows(joined, "gram long, name long, n long, lead long, count long, stretch binary", work)


def sent_once(pairs: Iterator[tuple], seen: dict) -> list[tuple]:
    """The pairs (key, string) that the task, as far as it remembers, has not sent; strings are compared, not hashed."""
    out = []
    for key, string in pairs:
        if (known := seen.get(key)) is None:
            if len(seen) < SEEN:
                seen[key] = string
        elif known == string:
            continue
        out.append((key, string))
    return out


def ambiguous(strings: DataFrame, keys: list[str]) -> bool:
    """Whether a key of (keys, string) has two different strings."""
    distinct = strings.groupBy(*keys, "string").agg(F.lit(1).alias("one"))
    return distinct.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def dealt_windows(ws: Workspace, stretches: DataFrame, length: int) -> DataFrame:
    """(gram, name, runs) as ``ordered_groups`` gives, for stretches of grams that are in too many of them for one task.

    Windows are dealt out one by one under digests, which are counted where the
    windows are before they are shuffled; then the bytes of those that occur
    again are compared, each sent once a task, and if two differ under one
    digest the next digest function is taken.
    """
    stretches = ws.table(stretches)
    for _, digest in NAMERS:
        dealt = ws.table(_window_table(stretches, length, digest))
        again = ws.table(dealt.groupBy("window").agg(F.sum("n").alias("times"), F.count("*").alias("rows")).where("times > 1"))
        found = join_groups(dealt, again, "window", "rows", dealt.count())
        numbers = ws.table(found.groupBy("gram", "name").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("k")).alias("ks")))
        told = stretches.select("gram", "name", "stretch").join(numbers, ["gram", "name"]).select("stretch", "ks")
        if not ambiguous(_window_bytes(told, length, digest), ["key"]):
            runs = F.flatten(F.transform("ks", lambda k: F.array(k, k)))
            return numbers.where("n = 1").select("gram", "name", runs.alias("runs"))
    raise RuntimeError("every digest function gave two different windows one digest")


def _window_table(stretches: DataFrame, length: int, digest: Digest) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            gram, name, n, _, count, stretch = (batch.column(k).to_pylist() for k in range(6))
            times = np.array(count, dtype=np.int64)
            of = np.repeat(np.arange(len(times)), times)
            windows = [digest(s[k : k + length]) for s, c in zip(stretch, count, strict=True) for k in range(c)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(windows, pa.binary()),
                    *(pa.array(np.array(x, dtype=np.int64)[of]) for x in (gram, name, n)),
                    pa.array(np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)),
                ],
                ["window", "gram", "name", "n", "k"],
            )

    return map_rows(stretches, "window binary, gram long, name long, n long, k long", work)


def _window_bytes(told: DataFrame, length: int, digest: Digest) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in small_batches(batches, 64):
            windows = (s[k : k + length] for s, ks in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k in ks)
            rows = sent_once(((digest(w), w) for w in windows), seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["key", "string"]
            )

    return map_rows(told, "key binary, string binary", work)


def ordered_groups(stretches: DataFrame, length: int, batch_rows: int) -> DataFrame:
    """(gram, name, runs): the repeated windows of each stretch that occurs once, as runs of window numbers."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        gram, name, n, lead, count, stretch = (list(c) for c in zip(*rows, strict=True))
        leads, counts, times = (np.array(x, dtype=np.int64) for x in (lead, count, n))
        repeated = repeated_windows(np.array(gram), stretch, leads, counts, times, length)
        out = []
        for k in range(len(rows)):
            if times[k] == 1:
                flags = repeated[k, leads[k] - counts[k] + 1 : leads[k] + 1][::-1]
                if flags.any():
                    out.append((gram[k], name[k], runs_of(flags)))
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["gram", "name", "runs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if len(held) >= batch_rows and row[0] != held[-1][0]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    ordered = stretches.repartition("gram").sortWithinPartitions("gram")
    return map_rows(ordered, "gram long, name long, runs array<long>", work)


def remove_repeats(
    docs: DataFrame,
    *,
    length: int = 200,
    group_limit: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Find and remove every byte that a repeated ``length``-byte string covers.

    Windows of ``length`` bytes are grouped by anchor; stretches of windows that
    occur whole more than once are repeated outright, and their bytes are
    compared.  Of those that occur once, only the ones whose anchor gram occurs
    elsewhere are ordered: radix passes go through the window's depth and no
    further, and windows that stay equal are the repeated ones.  Grams with more
    than ``group_limit`` different stretches are dealt out window by window
    instead, with the same result (``dealt_windows``).  Hashes only bring
    together what is then compared byte by byte.  Strings are judged on the
    input; matches never cross rows; overlaps count.

    Returns one row per input row: ``row`` (its address), ``doc_id``,
    ``n_bytes``, ``removed`` (maximal removed byte spans [start, end)) and
    ``kept`` (binary: the remaining bytes, concatenated).  Null texts are empty;
    repeated rows are texts like others; null ids are carried; very long texts
    are scanned in pieces; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    texts = addressed(docs).texts(id_col, text_col)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    packed = packed_texts(texts)
    for name, _ in NAMERS:
        with Workspace(docs.sparkSession) as ws:
            decisions = ws.deliver(_decisions(ws, texts, packed, length, group_limit, name))
        joined = packed.join(decisions.hint("shuffle_hash"), "row", "left")
        if not ambiguous(_whole_bytes(joined, length, name), ["gram", "name"]):
            schema = f"row {ROW}, doc_id {id_type}, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary"
            return map_rows(joined.select("row", "doc_id", "packed", "whole", "parts"), schema, _remover(length, name))
    raise RuntimeError("every naming function gave two different stretches one name")


def _decisions(ws: Workspace, texts: DataFrame, packed: DataFrame, length: int, group_limit: int, name: Namer) -> DataFrame:
    """(row, whole, parts): the stretches of each row that are repeated, whole or in part."""
    supermers = ws.table(supermer_table(texts, length, name))
    first = supermers.select("gram", "name", "n", F.col("rows")[0]["file"].alias("file"), F.col("rows")[0]["at"].alias("at"))
    distinct = ws.table(
        first.groupBy("gram", "name").agg(
            F.sum("n").alias("n"), F.first("file").alias("file"), F.first("at").alias("at"), F.count("*").alias("batches")
        )
    )
    grams = distinct.groupBy("gram").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single"))
    grams = ws.table(grams.where("kinds > 1 AND single > 0"))
    compared = ws.table(join_groups(distinct, grams, "gram", "kinds", distinct.count()).drop("single", "batches"))
    decided = distinct.where("n > 1").select("gram", "name", "batches", F.lit(None).cast("array<bigint>").alias("runs"))
    small, large = compared.where(F.col("kinds") <= group_limit), compared.where(F.col("kinds") > group_limit)
    some = ordered_groups(compared_stretches(packed, small, length, name), length, 4096)
    if large.limit(1).count():
        some = some.unionAll(dealt_windows(ws, compared_stretches(packed, large, length, name), length))
    once = some.select("gram", "name", F.lit(1).cast("long").alias("batches"), "runs")
    decided = ws.table(decided.unionAll(once))
    held = join_groups(supermers.select("gram", "name", "rows"), decided, ["gram", "name"], "batches", supermers.count())
    whole, key = F.col("runs").isNull(), F.struct("gram", "name")
    return (
        held.select(F.explode("rows").alias("row"), "gram", "name", "runs")
        .groupBy("row")
        .agg(
            F.collect_list(F.when(whole, key)).alias("whole"),
            F.collect_list(F.when(~whole, F.struct("gram", "name", "runs"))).alias("parts"),
        )
    )


def _whole_bytes(joined: DataFrame, length: int, name: Namer) -> DataFrame:
    """(gram, name, string): the bytes of each row's stretches that are taken for repeated whole, each sent once a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for part in small_batches(batches, 256, 4 << 20):
            texts = [unpack(p) for p in part.column(0).to_pylist()]
            asked = [{(w["gram"], w["name"]) for w in whole} for whole in part.column(1).to_pylist()]
            found = Supermers(texts, length, name)
            columns = (found.doc, found.start, found.count, to_signed(found.gram), to_signed(found.name))
            stretches = (
                ((g, m), texts[doc][start : start + count + length - 1])
                for doc, start, count, g, m in zip(*(c.tolist() for c in columns), strict=True)
                if (g, m) in asked[doc]
            )
            rows = sent_once(stretches, seen)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0][0] for r in rows], pa.int64()),
                    pa.array([r[0][1] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.binary()),
                ],
                ["gram", "name", "string"],
            )

    wanted = joined.where(F.size("whole") > 0).select("packed", "whole")
    return map_rows(wanted, "gram long, name long, string binary", work)


Rules = dict[tuple[int, int], list[int] | None]


def removed_spans(texts: list[bytes], rules: list[Rules], length: int, name: Namer) -> list[list[tuple[int, int]]]:
    """Maximal spans of bytes covered by the repeated windows of each text.

    Rules name a text's stretches with repeated windows; None stands for all of
    a stretch's windows, a list for runs of them.
    """
    change = [np.zeros(len(t) + 1, dtype=np.int32) if r else None for t, r in zip(texts, rules, strict=True)]
    found = Supermers([t if r else b"" for t, r in zip(texts, rules, strict=True)], length, name)
    columns = (found.doc, found.start, found.count, to_signed(found.gram), to_signed(found.name))
    for doc, start, count, *key in zip(*(c.tolist() for c in columns), strict=True):
        if (key := tuple(key)) in rules[doc]:
            runs = rules[doc][key]
            for a, b in [(0, count - 1)] if runs is None else zip(runs[::2], runs[1::2], strict=True):
                change[doc][start + a] += 1
                change[doc][start + b + length] -= 1
    out = []
    for c in change:
        if c is None:
            out.append([])
            continue
        covered = np.cumsum(c[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))).tolist()
        out.append(list(zip(edges[::2], edges[1::2], strict=True)))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in spans)]
    starts = [*(s for s, _ in spans), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends, starts, strict=True))


def _remover(length: int, name: Namer):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches, 256, 4 << 20):
            texts = [unpack(p) for p in part.column(2).to_pylist()]
            rules = [
                {(w["gram"], w["name"]): None for w in whole or ()} | {(p["gram"], p["name"]): p["runs"] for p in parts or ()}
                for whole, parts in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)
            ]
            spans = removed_spans(texts, rules, length, name)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(
                        [[{"start": a, "end": b} for a, b in s] for s in spans],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                    ),
                    pa.array([kept_bytes(t, s) for t, s in zip(texts, spans, strict=True)], pa.binary()),
                ],
                ["row", "doc_id", "n_bytes", "removed", "kept"],
            )

    return work
