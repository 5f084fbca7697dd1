"""Benchmark decontamination: an FM-index per shard of the corpus, searched for benchmark phrases."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import Rows, addressed, by_place, map_rows, picked, position, small_batches, texts_as_bytes

#: A-Z to a-z; ASCII other than letters and digits to a space; bytes of other characters stay.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)

SAMPLE = 8
#: Occurrences that are located at once.
LOT = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WaveletRanks:
    """Rank and access over a sequence of small integers: a levelwise wavelet tree on packed bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
            self.levels.append((packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])))
            self.zeros.append(len(symbols) - int(ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        packed, before = self.levels[level]
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` entries equal ``symbol``."""
        start = np.zeros_like(at)
        for level in range(self.bits):
            set_bit = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            ones_at, ones_start = self._ones(level, at), self._ones(level, start)
            at = np.where(set_bit, self.zeros[level] + ones_at, at - ones_at)
            start = np.where(set_bit, self.zeros[level] + ones_start, start - ones_start)
        return at - start

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry at each place and its rank among equal entries before it."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.bits):
            packed, _ = self.levels[level]
            bit = (packed[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones_at, ones_start = self._ones(level, at), self._ones(level, start)
            symbol = symbol << 1 | bit
            at = np.where(bit, self.zeros[level] + ones_at, at - ones_at)
            start = np.where(bit, self.zeros[level] + ones_start, start - ones_start)
        return symbol, at - start


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by rank doubling; only groups not yet told apart are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = heads
    step = 1
    open_rows = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]])))
    while len(open_rows):
        places = order[open_rows]
        after = places + step
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        head = rank[places]
        by = np.lexsort((follow, head))
        places, head, follow = places[by], head[by], follow[by]
        order[open_rows] = places
        fresh = np.concatenate([[True], (head[1:] != head[:-1]) | (follow[1:] != follow[:-1])])
        heads = np.maximum.accumulate(np.where(fresh, open_rows, 0))
        rank[places] = heads
        alone = fresh & np.concatenate([fresh[1:], [True]])
        open_rows = open_rows[~alone]
        step *= 2
    return order


class FMIndex:
    """FM-index over runs of symbols 1..n; each run ends in a terminator of its own that no search crosses."""

    def __init__(self, runs: list[np.ndarray], alphabet: int):
        ends = np.cumsum([len(r) + 1 for r in runs])
        text = np.zeros(int(ends[-1]) if len(runs) else 0, dtype=np.int64)
        starts = ends - np.array([len(r) + 1 for r in runs], dtype=np.int64)
        for start, run in zip(starts.tolist(), runs, strict=True):
            text[start : start + len(run)] = run
        unique = np.where(text > 0, text + len(runs), 0)
        unique[ends - 1] = np.arange(len(runs))
        order = suffix_order(unique)
        before = text[order - 1]
        self.size, self.alphabet = len(text), alphabet
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        self.ranks = WaveletRanks(before, max(1, alphabet.bit_length()))
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled, self.positions = sampled, order[sampled]
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [low, high) of phrases, given right-aligned in a matrix of symbols."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1]
        alive = np.arange(len(phrases))
        for step in range(width):
            alive = alive[(lengths[alive] <= step) | (low[alive] < high[alive])]
            now = alive[lengths[alive] > step]
            symbol = phrases[now, width - 1 - step]
            low[now] = self.first[symbol] + self.ranks.rank(symbol, low[now])
            high[now] = self.first[symbol] + self.ranks.rank(symbol, high[now])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by stepping back to a sampled one."""
        at, steps, out = rows.copy(), np.zeros_like(rows), np.empty_like(rows)
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[at[left]]
            hit = left[done]
            out[hit] = self.positions[self.sample_rank[at[hit]]] + steps[hit]
            left = left[~done]
            symbol, rank = self.ranks.access_rank(at[left])
            at[left] = self.first[symbol] + rank
            steps[left] += 1
        return out


class Phrases:
    """The distinct windows of a block of benchmark items, in symbols of its own vocabulary.

    ``matrix`` has a row a phrase, right-aligned; phrase k is in the items
    ``owner[owner_at[k] : owner_at[k + 1]]``, as numbers into ``names``.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window, self.symbol = window, {}
        self.names = sorted({name for name, _ in items if name is not None})
        number = {n: k for k, n in enumerate(self.names)}
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for name, text in items:
            words = words_of(text)
            if words:
                symbols = np.array([self.symbol.setdefault(w, len(self.symbol) + 1) for w in words], dtype=np.int32)
                if len(symbols) < window:
                    symbols = np.concatenate([np.zeros(window - len(symbols), np.int32), symbols])
                rows.append(np.lib.stride_tricks.sliding_window_view(symbols, window))
                owners.append(np.full(len(rows[-1]), number.get(name, -1)))
        every = np.ascontiguousarray(np.concatenate(rows))
        _, first, phrase = np.unique(every.view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
        self.matrix = every[first]
        self.lengths = np.count_nonzero(self.matrix, axis=1).astype(np.int64)
        pairs = np.unique(np.column_stack([phrase, np.concatenate(owners)]), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        self.owner = pairs[:, 1]
        self.owner_at = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.least = int(self.lengths.min()) if len(first) else 0

    def hits(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its number of words, its merged hit spans [start, end) in words, its items.

        Occurrences are located a bounded number at a time; of each lot only
        what its words cover and which phrases a text holds are kept.
        """
        counts, runs, where = [], [], []
        for doc, text in enumerate(texts):
            words = words_of(text)
            counts.append(len(words))
            if not self.least or len(words) < self.least:
                continue
            symbols = np.fromiter(map(self.symbol.get, words, repeat(0)), dtype=np.int64, count=len(words))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], symbols > 0, [0]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= self.least:
                    runs.append(symbols[a:b])
                    where.append((doc, a))
        out: list[tuple[int, list[tuple[int, int]], list[str]]] = [(n, [], []) for n in counts]
        if not runs:
            return out
        index = FMIndex(runs, len(self.symbol))
        low, high = index.search(self.matrix, self.lengths)
        run_starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in runs])])
        run_doc = np.array([d for d, _ in where])
        # Each text has a place more than it has words, so that spans of two texts never touch.
        base = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
        run_at = np.array([a for _, a in where]) + base[run_doc]
        change = np.zeros(int(base[-1]) + 1, dtype=np.int64)
        sizes = high - low
        before, total = np.cumsum(sizes) - sizes, int(sizes.sum())
        held = np.zeros(0, dtype=np.int64)
        for at in range(0, total, LOT):
            number = np.arange(at, min(at + LOT, total))
            phrase = np.searchsorted(before, number, side="right") - 1
            places = index.locate(low[phrase] + number - before[phrase])
            run = np.searchsorted(run_starts, places, side="right") - 1
            begin = run_at[run] + places - run_starts[run]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + self.lengths[phrase], -1)
            held = np.unique(np.concatenate([held, run_doc[run] * len(low) + phrase]))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(change) > 0]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            doc = int(np.searchsorted(base, a, side="right")) - 1
            out[doc][1].append((a - int(base[doc]), b - int(base[doc])))
        for some in np.split(held, np.flatnonzero(np.diff(held // len(low))) + 1) if len(held) else ():
            numbers = np.unique(np.concatenate([self.owner[self.owner_at[k] : self.owner_at[k + 1]] for k in (some % len(low)).tolist()]))
            out[int(some[0]) // len(low)][2].extend(self.names[k] for k in numbers.tolist())
        return out


def shards(batches: Iterator[pa.RecordBatch], text_at: int, size: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Row groups of about ``size`` text bytes, at least one row each."""
    for batch in small_batches(batches, 2048):
        texts = texts_as_bytes(batch.column(text_at))
        at = held = 0
        for k, text in enumerate(texts):
            held += len(text)
            if held >= size or k == len(texts) - 1:
                yield batch.slice(at, k + 1 - at), texts[at : k + 1]
                at, held = k + 1, 0


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's distinct items in blocks of about ``block_bytes`` (and at least an item); each is small enough to send to all tasks.

    The number of blocks follows the measured size, so a benchmark of any size
    is searched, one pass over the corpus for each block.
    """
    named = picked(benchmark, item=id_col, text=text_col)
    items = named.select(F.col("item").cast("string"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    blocks = 1 + total // block_bytes
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = items if blocks == 1 else items.where(part == k)
        yield [(r.item, bytes(r.text)) for r in rows.collect()]


SPANS = "array<struct<start:bigint,end:bigint>>"


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 13,
    block_bytes: int = 8 << 20,
    shard_bytes: int = 8 << 20,
    item_col: str = "item_id",
    item_text_col: str = "text",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Where benchmark phrases occur in documents.

    A phrase is any ``window`` consecutive words of an item, or a shorter item
    as a whole.  Each task indexes shards of its texts: of a shard, the runs of
    benchmark words long enough to hold a phrase.  Phrases are searched
    backwards through wavelet-tree ranks, occurrences are located by sampled
    suffix positions, and their word spans are merged.  With one block of
    benchmark items (the usual case) nothing is shuffled.

    Returns one row per input row: ``row`` (its address), ``doc_id``,
    ``n_words``, ``spans`` (merged, in words), ``items`` (ids of items with
    occurring phrases, sorted as strings).  Null texts have no words; items
    without words have no phrases; an item with a null id makes hits but is not
    listed; repeated items and rows count like others; a very long text is a
    shard of its own, of whose occurrences a bounded number is held at once;
    empty tables give no rows or no hits; other columns are ignored, whatever
    their names.
    """
    return _contamination(addressed(docs), benchmark, window, block_bytes, shard_bytes, item_col, item_text_col, id_col, text_col)


def _contamination(
    rows: Rows, benchmark: DataFrame, window: int, block_bytes: int, shard_bytes: int, item_col: str, item_text_col: str, id_col: str, text_col: str
) -> DataFrame:
    narrow = rows.texts(id_col, text_col)
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"row struct<file:bigint,at:bigint>, doc_id {id_type}, n_words long, spans {SPANS}, items array<string>"

    def searched(items: list[tuple]) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(items, window)
            for part, texts in shards(batches, 2, shard_bytes):
                found = phrases.hits(texts)
                spans = [[{"start": a, "end": b} for a, b in s] for _, s, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([i for _, _, i in found], pa.list_(pa.string())),
                    ],
                    ["row", "doc_id", "n_words", "spans", "items"],
                )

        return map_rows(narrow, schema, work)

    results = [searched(items) for items in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)]
    if len(results) == 1:
        return results[0]
    every = results[0]
    for more in results[1:]:
        every = every.unionAll(more)
    merged = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.withColumn("spans", merged_spans("spans"))


def merged_spans(name: str):
    """Sorted spans with overlapping and touching ones joined."""
    return F.expr(
        f"""aggregate({name}, cast(array() as {SPANS}), (done, s) ->
        CASE WHEN size(done) > 0 AND s.start <= element_at(done, -1).end
        THEN concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start,
             'end', greatest(element_at(done, -1).end, s.end))))
        ELSE concat(done, array(s)) END)"""
    )


def hit_words(name: str = "spans"):
    return F.expr(f"aggregate({name}, 0L, (n, s) -> n + s.end - s.start)")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    share: int = 20,
    window: int = 13,
    block_bytes: int = 8 << 20,
    shard_bytes: int = 8 << 20,
    item_col: str = "item_id",
    item_text_col: str = "text",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` of which less than one word in ``share`` is hit (or none); all columns are kept, whatever their names.

    The phrases are searched in the same task that passes a row on, so nothing
    is shuffled; a benchmark of several blocks takes a pass for each.  Null and
    empty texts have no words and stay; repeated rows are judged alike; very
    long texts are a shard each; an empty benchmark drops nothing and an empty
    table stays empty.
    """
    blocks = list(benchmark_blocks(benchmark, item_col, item_text_col, block_bytes))
    if len(blocks) == 1:
        items, text_at = blocks[0], position(docs, text_col)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(items, window)
            for part, texts in shards(batches, text_at, shard_bytes):
                hit = [(sum(b - a for a, b in spans), n) for n, spans, _ in phrases.hits(texts)]
                yield part.filter(pa.array([h == 0 or share * h < n for h, n in hit], pa.bool_()))

        placed = by_place(docs)
        return map_rows(placed, T.StructType(placed.schema.fields), work).toDF(*docs.columns)
    rows = addressed(docs)
    found = _contamination(rows, benchmark, window, block_bytes, shard_bytes, item_col, item_text_col, id_col, text_col)
    return rows.keep(found.where((hit_words() == 0) | (share * hit_words() < F.col("n_words"))))
