"""Byte-level BPE with rank files: texts to ids and back.

A text is cut into units (white space and what follows it), a unit by the pattern into pieces, and a piece that is no entry itself is merged. The
pieces that a task meets for the first time are merged together: bucketed by length, as rows of padded matrices of ids. In each round every row
merges its leftmost pair of least rank; the ranks of pairs are looked up in a hash table, and rows without a pair left are taken out. Units are
remembered with their ids. No piece that the pattern can match goes on from a character into white space, so units change nothing.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, table

#: White space of Unicode and what is none. Python's own class also holds U+001C to U+001F.
UNIT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
NONE = np.iinfo(np.int32).max
#: Rows longer than this many bytes are merged one by one with a heap: a round a merge would take time with the square of the length.
LONGEST_ROW = 256
#: Cells of one matrix.
CELLS = 1 << 20
#: Units that a worker remembers (up to twice as many just before it forgets), and the longest of them.
CACHE_UNITS, CACHE_LENGTH = 200_000, 64
#: Characters and units that are taken at once; a longer text goes in parts.
AT_ONCE, UNITS_AT_ONCE = 1 << 20, 200_000


class PairTable:
    """Ranks of pairs of ids in an open-addressing hash table; a look-up takes whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.mask = (1 << max(4, int(4 * len(left)).bit_length())) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self.slot(key)
        left_over = np.arange(len(key))
        while len(left_over):
            free = left_over[self.keys[slot[left_over]] < 0]
            at, one = np.unique(slot[free], return_index=True)
            self.keys[at], self.ranks[at] = key[free[one]], rank[free[one]]
            left_over = left_over[self.keys[slot[left_over]] != key[left_over]]
            slot[left_over] = slot[left_over] + 1 & self.mask

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (mixed(key.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def get(self, left: int, right: int) -> int:
        """One pair's rank."""
        key = left << 32 | right
        slot = int(self.slot(np.array([key]))[0])
        while self.keys[slot] >= 0:
            if self.keys[slot] == key:
                return int(self.ranks[slot])
            slot = slot + 1 & self.mask
        return NONE

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is none or an id is below zero."""
        shape = left.shape
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(key), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        key, slot = key[todo], self.slot(key[todo])
        while len(todo):
            held = self.keys[slot]
            hit = held == key
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (held >= 0)
            todo, key, slot = todo[on], key[on], slot[on] + 1 & self.mask
        return out.reshape(shape)


class Recent(dict):
    """Strings of up to CACHE_LENGTH characters with their ids; past its size only what was met since the last time it filled up."""

    def __init__(self, size: int | None = None) -> None:
        self.size, self.before = size or CACHE_UNITS, {}

    def __missing__(self, key: str) -> bytes | None:
        return self.before.get(key)

    def add(self, found: dict[str, bytes]) -> None:
        if len(self) + len(found) > self.size:
            self.before = dict(self)
            self.clear()
        self.update({u: x for u, x in found.items() if len(u) <= CACHE_LENGTH})


class ByteBpe:
    """Byte-level BPE; pattern cuts texts into pieces.

    entries have ids. As rank files have it, a piece that is an entry is taken whole, and a pair's rank is the id of the entry that it makes. With merges (pairs
    of ids, in order) those alone are made, by their place.
    """

    def __init__(self, entries: dict[bytes, int], pattern: str, merges: list[tuple[int, int]] | None = None, remembered: int | None = None) -> None:
        import regex

        self.split = regex.compile(pattern).findall
        self.single = np.array([entries[bytes([i])] for i in range(256)], np.int32)
        size = max(entries.values()) + 1
        self.words = [b""] * size
        for word, i in entries.items():
            self.words[i] = word
        if merges is None:
            pairs = [(entries[w[:i]], entries[w[i:]], r) for w, r in entries.items() for i in range(1, len(w)) if w[:i] in entries and w[i:] in entries]
            self.made, self.whole = np.arange(size, dtype=np.int32), entries
        else:
            pairs = [(a, b, r) for r, (a, b) in enumerate(merges)]
            self.made, self.whole = np.array([entries[self.words[a] + self.words[b]] for a, b in merges], np.int32), {}
        self.pairs = PairTable(*np.array(pairs, np.int32).reshape(-1, 3).T)
        self.units, self.pieces = Recent(remembered), Recent(remembered)

    @classmethod
    def of(cls, path: str, pattern: str) -> ByteBpe:
        """One for each rank file and pattern in a worker process, which tasks share."""
        if (path, pattern) not in ENCODERS:
            ENCODERS[path, pattern] = cls(read_ranks(path), pattern)
        return ENCODERS[path, pattern]

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids, padded with -1 at the end -> the same after all merges."""
        out = np.full(ids.shape, -1, np.int32)
        rows, ranks = np.arange(len(ids)), self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if not ranks.shape[1]:
                out[rows, : ids.shape[1]] = ids
                break
            at = ranks.argmin(axis=1)  # the leftmost of the least
            least = ranks[np.arange(len(rows)), at]
            on = least < NONE
            if not on.all():
                out[rows[~on], : ids.shape[1]] = ids[~on]
                rows, ids, ranks, at, least = rows[on], ids[on], ranks[on], at[on], least[on]
                if not len(rows):
                    break
            column, each = np.arange(ids.shape[1] - 1), np.arange(len(rows))
            ids = np.where(column <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[each, at] = self.made[least]
            ranks = np.where(column[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            for side in (at - 1, at):
                k = np.flatnonzero((side >= 0) & (side < ranks.shape[1]))
                ranks[k, side[k]] = self.pairs(ids[k, side[k]], ids[k, side[k] + 1])
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """One long piece by the same rule: a heap of pairs by rank and place, over linked places."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.pairs(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks.tolist()) if r < NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            if after[i] < n:
                pair = ids[i], ids[after[i]]
                if pair not in known:
                    known[pair] = self.pairs.get(*pair)
                if known[pair] < NONE:
                    heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes of 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words])
        bucket = np.ceil(np.log2(np.maximum(size, 2))).astype(int)
        for k in np.unique(bucket[size <= LONGEST_ROW]).tolist():
            width = 1 << k
            which = np.flatnonzero((bucket == k) & (size <= LONGEST_ROW))
            for i in range(0, len(which), max(1, CELLS // width)):
                some = which[i : i + max(1, CELLS // width)]
                cells = np.frombuffer(b"".join(words[j].ljust(width, b"\0") for j in some.tolist()), np.uint8).reshape(-1, width)
                ids = self.merge_rows(np.where(np.arange(width) < size[some][:, None], self.single[cells], np.int32(-1)))
                ends = np.cumsum((ids >= 0).sum(axis=1)) * 4
                flat = ids[ids >= 0].tobytes()
                for j, a, b in zip(some.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[j] = flat[a:b]
        for j in np.flatnonzero(size > LONGEST_ROW).tolist():
            out[j] = self.merge_long(words[j]).tobytes()
        return out

    def cut(self, unit: str) -> list[str]:
        """The pieces of a unit. Most units are a word of ASCII letters, perhaps with a mark: there the pattern has no say."""
        if unit.isascii():
            word = unit[1:] if unit[0] == " " else unit
            if word.isalpha():
                return [unit]
            if word[:-1].isalpha() and word[-1] in ".,;:!?":
                return [unit[:-1], unit[-1]]
        return self.split(unit)

    def learn(self, units: set[str]) -> dict[str, bytes]:
        """The ids of units that are not remembered."""
        cut = {u: self.cut(u) for u in units}
        new = {p for parts in cut.values() for p in parts}
        known = {p: x for p in new if (x := self.pieces[p]) is not None}
        raw = {p: p.encode() for p in new if p not in known}
        whole = {p: self.whole[w].to_bytes(4, "little") for p, w in raw.items() if w in self.whole}
        rest = [p for p in raw if p not in whole]
        whole.update(zip(rest, self.merge([raw[p] for p in rest]), strict=True))
        self.pieces.add(whole)
        known |= whole
        found = {u: known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts]) for u, parts in cut.items()}
        self.units.add(found)
        return found

    def joined(self, units: list[list[str]]) -> list[bytes]:
        """The ids of each list of units."""
        got = [list(map(self.units.__getitem__, some)) for some in units]
        new = {u for some, ids in zip(units, got, strict=True) for u, x in zip(some, ids, strict=True) if x is None}
        if new:
            found = self.learn(new)
            got = [[found[u] if x is None else x for u, x in zip(some, ids, strict=True)] for some, ids in zip(units, got, strict=True)]
        return [b"".join(ids) for ids in got]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of 32-bit integers. None is as the empty text."""
        out: list[bytes] = []
        held: list[list[str]] = []
        size = 0
        for text in texts:
            if text and len(text) > AT_ONCE:
                out += self.joined(held)
                found, parts = UNIT.finditer(text), []
                while some := [m.group() for m in itertools.islice(found, UNITS_AT_ONCE)]:
                    parts += self.joined([some])
                out.append(b"".join(parts))
                held, size = [], 0
                continue
            held.append(UNIT.findall(text) if text else [])
            size += len(text or "")
            if size > AT_ONCE:
                out += self.joined(held)
                held, size = [], 0
        return out + self.joined(held)

#: One for each rank file in a worker process, which tasks share.
ENCODERS: dict[tuple[str, str], ByteBpe] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}


def gathered(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The entries ids of a table of byte strings (end to end in data), end to end."""
    size = offsets[ids + 1] - offsets[ids]
    ends = np.cumsum(size)
    return data[np.repeat(offsets[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """docs: doc_id, text -> doc_id, ids (array of int): every whole text by the rank file, each match of the pattern by itself, no special tokens.

    A row for each row, repeated ones too. A null text is empty, and an empty one has no ids. Of equal ranks in a piece the leftmost merges first. A very
    long text goes in parts of 200,000 units; a very long piece is merged with a heap. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(ranks, pattern)
        for batch in batches:
            for some in portions(batch):
                ids = bpe.encode(some.column(1).to_pylist())
                pa.default_memory_pool().release_unused()
                values = pa.Array.from_buffers(pa.int32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """encoded: doc_id, ids -> doc_id, ids, decoded (binary): the bytes that the ids stand for. Null ids are as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = read_ranks(ranks)
        words = [b""] * (max(entries.values()) + 1)
        for word, i in entries.items():
            words[i] = word
        data, offsets = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])
        del entries, words
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                lists = [(x.values or pa.array([], pa.int32())).to_numpy() for x in some.column(1)]
                raw = [gathered(x, data, offsets).tobytes() for x in lists]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def portions(batch: pa.RecordBatch, column: int = 1, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes of a string column; a longer row is whole."""
    at = 0
    if batch.num_rows:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy())
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def encoded_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids as decimal numbers and of the decoded bytes."""
    both = decode(encode(docs, ranks, pattern), ranks)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
