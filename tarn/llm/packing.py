"""Packing: best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import map_rows, small_batches

#: The split pattern of byte-level BPE vocabularies of this family.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts longer than this are tokenised in parts, so that one text's ids are never all Python objects.
PART_CHARS = 1 << 18

#: tiktoken's pattern engine runs out of stack on longer white space; ``tokenizers`` does not.
LONG_SPACE = re.compile(r"\s{50000}")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted.

    Printable Latin-1 bytes stand for themselves; the others take the
    characters from U+0100 on, in byte order.
    """
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """The byte-level BPE in a ``tokenizers`` JSON file, run by tiktoken; None if the file holds another kind.

    Ids equal those of ``tokenizers`` on the same file (tested); this encoder is
    about six times as fast.  Added tokens are no part of it, see ``encode``.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    before, model = held.get("pre_tokenizer") or {}, held["model"]
    if (
        held.get("normalizer")
        or (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) != ("ByteLevel", False, True)
        or model.get("type") != "BPE"
        or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        or any(t.get(k) for t in held.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip"))
    ):
        return None
    special = {t["content"] for t in held.get("added_tokens", ())}
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): rank for token, rank in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """A pattern of the file's added tokens, the longest first, and their ids."""
    with open(path, encoding="utf-8") as file:
        found = {t["content"]: t["id"] for t in json.load(file).get("added_tokens", ())}
    names = sorted(found, key=len, reverse=True)
    return (re.compile("|".join(map(re.escape, names))) if names else None), found


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cut a long text before single spaces between words, where no token spans the cut."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while (cut := text.find(" ", cut)) > 0 and (
            cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()
        ):
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(maxsize=2)
def plain_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(path: str, text: str, end_id: int) -> np.ndarray:
    """A document's ids as ``tokenizers`` gives them without added special tokens, then ``end_id``.

    An added token's string in a text is that token, and the text before and
    after it is tokenised by itself.
    """
    fast, (added, numbers) = byte_bpe(path), added_tokens(path)
    found: list[np.ndarray] = []

    def plain(stretch: str) -> None:
        for part in parts(stretch):
            if LONG_SPACE.search(part):
                ids = plain_tokenizer(path).encode(part, add_special_tokens=False).ids
            else:
                ids = fast.encode_ordinary(part)
            found.append(np.array(ids, dtype="<u4"))

    if fast is None:
        found.append(np.array(plain_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype="<u4"))
    else:
        at = 0
        for m in added.finditer(text) if added else ():
            plain(text[at : m.start()])
            found.append(np.array([numbers[m[0]]], dtype="<u4"))
            at = m.end()
        plain(text[at:])
    return np.concatenate([*found, np.array([end_id], dtype="<u4")])


class TightestWindow:
    """Open windows in a segment tree indexed by remaining capacity.

    Each node counts the windows in its range of capacities; a search climbs to
    the nearest ancestor with windows at or above a length, then descends left.
    """

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, name: int) -> None:
        self.open[capacity].append(name)
        self._change(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the least capacity >= length."""
        count, node = self.count, self.leaves + length
        if not count[node]:
            while node & 1 or not count[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) for each length; all lengths are 1..window."""
    tree, opened = TightestWindow(window), 0
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        capacity, name = tree.take(lengths[k]) or (window, opened)
        opened = max(opened, name + 1)
        placed[k] = name, window - capacity
        if capacity > lengths[k]:
            tree.add(capacity - lengths[k], name)
    return placed


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    window: int = 1024,
    end_id: int = 0,
    shard_pieces: int = 16384,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack tokenised documents into windows of at most ``window`` ids.

    Each document is its token ids followed by ``end_id``.  Overlong documents
    are first cut into full windows, which are written at once; what remains of
    each document is packed by best-fit decreasing among the remainders of the
    same partition, up to ``shard_pieces`` at a time, so a task holds a bounded
    number of ids and no row is shuffled.  Of a full lot only well-filled windows
    are closed; the pieces of the others are packed again with the next lot.

    Returns one row per piece: ``doc_id``, ``start`` (ids of its document before
    it), ``length``, ``ids`` (binary: unsigned little-endian 32-bit ids),
    ``doc_tokens``, ``sequence_id`` (unique over all partitions) and ``offset``.
    Null and empty texts are the single id ``end_id``; null and repeated
    document ids are carried as they are; an empty table gives no pieces; other
    columns of ``docs`` are ignored.  Very long texts are tokenised in parts.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (task.partitionId() if (task := TaskContext.get()) else 0) << 34
        used, ready, waiting, ready_ids = 0, [], [], 0
        kind = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def packed(last: bool) -> list[tuple]:
            """Pieces of the windows that are done: all at last, before it the well-filled ones (all if too few are)."""
            nonlocal used, waiting
            lengths = [len(w[2]) // 4 for w in waiting]
            places = best_fit_decreasing(lengths, window)
            filled = np.zeros(1 + max((name for name, _ in places), default=-1), dtype=np.int64)
            for (name, _), length in zip(places, lengths, strict=True):
                filled[name] += length
            done = np.ones(len(filled), dtype=bool) if last else filled * 64 >= 63 * window
            if 2 * sum(not done[name] for name, _ in places) > len(places):
                done[:] = True
            number = first + used + np.cumsum(done) - 1
            rows = [
                (doc, start, len(ids) // 4, ids, total, int(number[name]), offset)
                for (doc, start, ids, total), (name, offset) in zip(waiting, places, strict=True)
                if done[name]
            ]
            used += int(done.sum())
            waiting = [piece for piece, (name, _) in zip(waiting, places, strict=True) if not done[name]]
            return rows

        for part in small_batches(batches):
            kind = part.schema.field(0).type
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = encode(tokenizer_path, text or "", end_id)
                total = len(ids)
                full = total - total % window
                for at in range(0, full, window):
                    ready.append((doc, at, window, ids[at : at + window].tobytes(), total, first + used, 0))
                    used += 1
                    ready_ids += window
                    if ready_ids >= 1 << 20:
                        yield batch(ready)
                        ready, ready_ids = [], 0
                if full < total:
                    waiting.append((doc, full, ids[full:].tobytes(), total))
                    if len(waiting) >= shard_pieces:
                        rows = packed(False)
                        for at in range(0, len(rows), 2048):
                            yield batch(rows[at : at + 2048])
        rows = ready + packed(True)
        for at in range(0, len(rows), 2048):
            yield batch(rows[at : at + 2048])

    schema = (
        f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return map_rows(docs.select(F.col(id_col), F.col(text_col).cast("string")), schema, work)
