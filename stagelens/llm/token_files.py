"""Token ids in files of Simple-8b words.

Documents are sorted by id over range partitions; each partition is a file, and its rows are segments: a table of the ids that
occur in the segment, most frequent first, the documents' ids and lengths, and their ids as ranks in that table, cut into
blocks of BLOCK ranks. A block is a run of 64-bit words: the top 4 bits select how many values of how many bits share the other 60.
Ranks of ESCAPE and above, and none else, are written as the value ESCAPE and kept, in order, in the segment's list of escapes, so a rare id
does not widen its neighbours. Words and escapes have an offset for each block, so blocks can be read alone; packing and unpacking
run over all blocks at once. Spark writes the files (Parquet as the container), so its commit protocol covers lost executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from string import ascii_letters, punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, table, utf8
from .tokens import BYTE, U, runs, word_hashes

BLOCK = 1024
ESCAPE = (1 << 12) - 1
#: (values, bits) by selector; the first two hold runs of zeros.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([n for n, _ in SELECTORS])
END_ID = 2
#: Plain white space, and values of bytes for the second hash of a word.
SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
OTHER_BYTE = np.random.default_rng(40_093).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
#: ASCII letters and marks.
LETTER, MARK = (np.isin(np.arange(256), list(x)) for x in (ascii_letters.encode(), punctuation.encode()))
#: Words whose ids a task remembers; then it starts anew.
CACHE_WORDS = 600_000

FILE_SCHEMA = "part int, segment int, first long, id_table array<int>, doc_ids array<long>, lengths array<int>, words binary, word_offsets array<int>, escapes array<int>, escape_offsets array<int>"


def _steps(width: np.ndarray) -> np.ndarray:
    """At each place, the selector that packs most values from there on, by their widths in bits (places past the end have none)."""
    run = {1: width}  # longest width of the next n values, by doubling
    n = 1
    while n < 240:
        run[2 * n] = run[n].copy()
        np.maximum(run[n][:-n], run[n][n:], out=run[2 * n][:-n])
        n *= 2
    sel = np.full(len(width), 15, dtype=np.uint8)
    for s in range(14, -1, -1):
        count, bits = SELECTORS[s]
        n = 1 << (count.bit_length() - 1)
        widest = run[n].copy()
        if count > n:
            np.maximum(run[n][: n - count], run[n][count - n :], out=widest[: n - count])
        sel[widest <= bits] = s
    return sel


def _groups(sel: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(words of a selector, its count of values, their bits), where it holds any bits."""
    for s, (count, bits) in enumerate(SELECTORS):
        if bits and len(mine := np.flatnonzero(sel == s)):
            yield mine, count, bits


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-negative integers below 2^60 to (words uint64, word offsets by block, escapes, escape offsets by block)."""
    n = len(values)
    blocks = -(-n // BLOCK)
    escaped = values >= ESCAPE
    escapes = values[escaped].astype(np.int64)
    escape_offsets = np.searchsorted(np.flatnonzero(escaped), np.arange(blocks + 1) * BLOCK)
    v = np.zeros(n + 240, dtype=np.uint64)
    v[:n] = np.where(escaped, ESCAPE, values)
    sel = _steps(np.array([x.bit_length() for x in range(ESCAPE + 1)], dtype=np.uint8)[v.astype(np.int64)])
    ahead = COUNTS[sel]
    at = np.arange(blocks) * BLOCK
    end = np.minimum(at + BLOCK, n)
    live, starts, owner = np.arange(blocks), [], []
    while len(live):
        p = at[live]
        starts.append(p)
        owner.append(live)
        at[live] = p + ahead[p]
        live = live[at[live] < end[live]]
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), escapes, np.zeros(1, np.int64)
    p, own = np.concatenate(starts), np.concatenate(owner)
    p, own = np.sort(p), np.sort(own)
    chosen = sel[p]
    words = chosen.astype(np.uint64) << np.uint64(60)
    room = end[own] - p  # the last word of a block may have values of the next one in reach: they stay out
    for mine, count, bits in _groups(chosen):
        i, w = p[mine], np.zeros(len(mine), np.uint64)
        for j in range(count):
            w |= np.where(room[mine] > j, v[i + j], np.uint64(0)) << np.uint64(bits * j)
        words[mine] |= w
    return words, np.searchsorted(own, np.arange(blocks + 1)), escapes, escape_offsets


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n values of pack."""
    out = np.zeros(n + 240, dtype=np.int64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(COUNTS[sel])])
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = block * BLOCK + before[:-1] - before[offsets[block]]
    room = np.minimum((block + 1) * BLOCK, n) - at
    for mine, count, bits in _groups(sel):
        w, i, r = words[mine], at[mine], room[mine]
        for j in range(count):
            x = (w >> np.uint64(bits * j) & np.uint64((1 << bits) - 1)).astype(np.int64)
            if j and (r <= j).any():
                x, k = x[r > j], i[r > j] + j
                out[k] = x
            else:
                out[i + j] = x
    out = out[:n]
    out[out == ESCAPE] = escapes
    return out


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - start, n)


class WordIds:
    """The ids (16 bits) of runs of text without plain white space, each asked of the tokenizer once; which run is which is told by two 64-bit hashes.

    The tokenizer drops white space and joins nothing across it, so a text's ids are its words' ids in order. A run of letters is one word to it,
    whose last piece alone ends a word: many are encoded in one call and told apart by that. Letters with ASCII marks behind are the two in turn. Runs
    with anything else in them are encoded alone.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.ends[i] = piece.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.marks: dict[str, bytes] = {}
        # of all words, in order of the first hash: it, the other, where their ids begin, and how many
        self.first, self.second, self.at, self.n = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u2")

    def alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Of words of letters only."""
        out = []
        groups = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, dtype="<u2")
            cuts = (2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(group):
                raw = ids.tobytes()
                out += [raw[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]
            else:
                out += map(self.alone, group)
        return out

    def learn(self, words: list[str], letters: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """Words that are not known yet, in order of the first hash; letters: which are of ASCII letters only."""
        plain, odd = np.flatnonzero(letters).tolist(), np.flatnonzero(~letters).tolist()
        parts = [(i, stem, words[i][len(stem) :]) for i in odd for stem in (words[i].rstrip(punctuation),)]
        stems = list({stem for _, stem, _ in parts if stem.isalpha()})  # of letters beyond ASCII
        batch = self.ids_of([words[i] for i in plain] + stems)
        found = [b""] * len(words)
        for i, x in zip(plain, batch, strict=False):
            found[i] = x
        known = dict(zip(stems, batch[len(plain) :], strict=True))
        for i, stem, mark in parts:
            if stem not in known:
                found[i] = self.alone(words[i])
            elif mark:
                if mark not in self.marks:
                    self.marks[mark] = self.alone(mark)
                found[i] = known[stem] + self.marks[mark]
            else:
                found[i] = known[stem]
        n = np.array([len(x) // 2 for x in found], np.int64)
        place = np.searchsorted(self.first, first)
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u2")])
        self.first, self.second, self.at, self.n = (np.insert(x, place, y) for x, y in ((self.first, first), (self.second, second), (self.at, at), (self.n, n)))

    def encode(self, column: pa.Array, at_once: int = 1 << 20) -> list[np.ndarray]:
        """The ids of whole texts, each with the end id."""
        data, offsets = utf8(column)
        out: list[np.ndarray] = []
        row = 0
        while row < len(column):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + at_once, side="right")) - 1)
            out += self.encode_slice(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
            row = stop
        return out

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        start, end, doc = runs(~SPACE[data], offsets)
        if not len(start):
            return [np.array([END_ID], "<u2") for _ in offsets[1:]]
        # letters, then marks: two words
        stem = np.maximum.accumulate(np.where(MARK[data], -1, np.arange(len(data))))[end - 1] + 1
        other = np.concatenate([[0], np.cumsum(~LETTER[data], dtype=np.int32)])
        letters = (stem > start) & (other[np.maximum(stem, start)] == other[start])
        two = np.flatnonzero(letters & (stem < end))
        order = np.argsort(np.concatenate([start, stem[two]]), kind="stable")
        end = np.concatenate([np.where(letters, stem, end), end[two]])[order]
        start, doc = np.concatenate([start, stem[two]])[order], np.concatenate([doc, doc[two]])[order]
        letters = np.concatenate([letters, np.zeros(len(two), bool)])[order]
        first, second = (word_hashes(data, start, end, table) for table in (BYTE, OTHER_BYTE))
        kinds, one, which = np.unique(first, return_index=True, return_inverse=True)
        if (second != second[one][which]).any():  # two words of one first hash
            return self.one_by_one(data, offsets)
        if len(self.first) + len(kinds) > CACHE_WORDS:
            self.forget()
        place = np.minimum(np.searchsorted(self.first, kinds), max(0, len(self.first) - 1))
        seen = self.first[place] == kinds if len(self.first) else np.zeros(len(kinds), bool)
        if (self.second[place[seen]] != second[one[seen]]).any():
            return self.one_by_one(data, offsets)
        new = one[~seen]
        if len(new):
            raw = data.tobytes()
            self.learn([raw[i:j].decode("utf-8") for i, j in zip(start[new].tolist(), end[new].tolist(), strict=True)], letters[new], kinds[~seen], second[new])
            place = np.searchsorted(self.first, kinds)
        at, n = self.at[place][which], self.n[place][which]
        ids = self.ids[ranges(at, n)]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, n, len(offsets) - 1).astype(np.int64))]).tolist()
        stop = np.array([END_ID], "<u2")
        return [np.concatenate([ids[i:j], stop]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def one_by_one(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        raw = data.tobytes()
        return [np.frombuffer(self.alone(raw[i:j].decode("utf-8")) + END_ID.to_bytes(2, "little"), "<u2") for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


#: One for each tokenizer file in a worker process, which tasks share.
ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in ENCODERS:
        ENCODERS[path] = WordIds(path)
    return ENCODERS[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, segment_ids: int = 500_000, files: int | None = None) -> DataFrame:
    """docs: doc_id, text -> the files at path, as a DataFrame of FILE_SCHEMA.

    Documents are in ascending doc_id order over the files and in them (null ids first; equal ids by text). A null or empty text has the
    end id alone. A text is never cut: a segment closes after the document that fills it. An empty table writes no segment.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, part, segment, first = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            stream = np.concatenate(ids)
            seen = np.bincount(stream)
            table = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)].astype(np.int32)
            rank = np.zeros(len(seen), dtype=np.int64)
            rank[table] = np.arange(len(table))
            words, offsets, escapes, escape_offsets = pack(rank[stream])
            row = {"part": part, "segment": segment, "first": first, "id_table": table, "doc_ids": docs, "lengths": [len(x) for x in ids], "words": words.astype("<u8").tobytes(), "word_offsets": offsets, "escapes": escapes, "escape_offsets": escape_offsets}
            kinds = {"part": pa.int32(), "segment": pa.int32(), "first": pa.int64(), "doc_ids": pa.list_(pa.int64()), "words": pa.binary()}
            return pa.RecordBatch.from_pydict({k: pa.array([x], kinds.get(k, pa.list_(pa.int32()))) for k, x in row.items()})

        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # a batch's texts and ids are not held together
                some = batch.slice(at, 500)
                for doc, text_ids in zip(some.column(0).to_pylist(), words_of.encode(some.column(1)), strict=True):
                    ids.append(text_ids)
                    docs.append(doc)
                    held += len(ids[-1])
                    if held >= segment_ids:
                        yield flush()
                        segment, first, held = segment + 1, first + held, 0
                        ids.clear()
                        docs.clear()
            pa.default_memory_pool().release_unused()
        if ids:
            yield flush()

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ranged.mapInArrow(encode, FILE_SCHEMA), path)


def read_token_files(files: DataFrame) -> DataFrame:
    """part, doc_id, start (in its file), n_tokens, ids (binary of little-endian unsigned 32-bit integers), decoded from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda c: batch.column(c)[i].values.to_numpy()  # noqa: B023, E731
                lengths = of("lengths").astype(np.int64)
                ranks = unpack(np.frombuffer(batch.column("words")[i].as_buffer(), "<u8"), of("word_offsets"), of("escapes").astype(np.int64), int(lengths.sum()))
                ids = of("id_table").astype("<u4")[ranks]
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(ends), batch.column("part")[i].as_py(), np.int32)), "doc_id": batch.column("doc_ids")[i].values, "start": pa.array(batch.column("first")[i].as_py() + ends - lengths),
                    "n_tokens": pa.array(lengths), "ids": pa.array([ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.binary()),
                })

    return files.mapInArrow(decode, "part int, doc_id long, start long, n_tokens long, ids binary")


def file_starts(files: DataFrame) -> DataFrame:
    """part, file_start: ids in all files before. One row a file, of counts that the segments carry."""
    from pyspark.sql import Window

    sizes = files.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    return sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_token_files(table(spark, sf_dir, "documents"), scratch(spark), public_tokenizers.path("word_bpe_49k.json"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([zlib.crc32(x.as_py()) for x in b.column(4)], pa.int64())], [*b.schema.names[:4], "ids_crc32"])

    out = read_token_files(files).mapInArrow(sums, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.join(F.broadcast(file_starts(files)), "part").select("doc_id", (F.col("start") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")
