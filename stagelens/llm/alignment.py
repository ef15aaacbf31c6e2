"""How the tokens of two tokenizers lie over each other, and how often which ids do.

Tokens are cut into groups at byte offsets where tokens of both end. A byte range of a document gives a fragment: an open prefix (tokens up to and with
the first common end), closed groups, and an open suffix (tokens behind the last common end); without a common end all of it is open. Fragments
compose associatively: a suffix and the next prefix make a closed group. Documents of up to LONG characters are a fragment each. Longer ones are cut into
parts, tokenized in tasks of their own, each part into byte ranges; the open ends of neighbouring fragments are composed in a tree over Spark tasks,
whose rounds leave their closed groups as rows where they arise.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import UNIT, UNITS_AT_ONCE, ByteBpe, Recent, gathered, portions
from .common import Packed, materialize, sent, table, utf8

#: White space where a part may end: no token of either tokenizer goes on from a character into it.
GAP = re.compile(r"(?<=[\S\x1c-\x1f])[^\S\x1c-\x1f]")
#: Texts of more characters than this are cut, into parts of at least PART characters and byte ranges of RANGE bytes. FAN fragments are composed at a time.
LONG, PART, RANGE, FAN = 1 << 20, 1 << 19, 1 << 16, 16
#: Units that a worker remembers by each tokenizer.
REMEMBERED = 300_000
#: Up to so many pairs of ids (16 bytes each) are sent to all tasks; more are joined by shuffle. The result is the same.
SENT_PAIRS = 3_000_000
SLICE = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_byte_level(path: str, pattern: str) -> ByteBpe:
    """A byte-level BPE tokenizer file of merges. Special tokens are no entries: their strings are plain text."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    raw = {w: bytes(letters[c] for c in w) for w in model["vocab"] if all(c in letters for c in w)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = {w for m in merges for w in (*m, "".join(m))} | {w for w in raw if len(w) == 1}
    entries = {raw[w]: i for w, i in model["vocab"].items() if w in made}
    return ByteBpe(entries, pattern, [(model["vocab"][a], model["vocab"][b]) for a, b in merges], REMEMBERED)


@dataclass
class Vocabulary:
    """Byte strings by id, end to end."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Vocabulary:
        return cls(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64))

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.offsets[ids + 1] - self.offsets[ids]


class TwoTokenizers:
    """Ids of both tokenizers for space+text, unit by unit (white space and what follows it); units are remembered."""

    def __init__(self, byte_level: str, piece_model: str, pattern: str) -> None:
        import sentencepiece

        self.bpe = read_byte_level(byte_level, pattern)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        #: No piece has white space behind another character, so that pieces never cross the edge of a unit.
        self.cuts = not any(re.search(r"[^▁][\s▁]", n) or re.search(r"\s.", n) for n in names)
        self.a = Vocabulary.of(self.bpe.words)
        self.b = Vocabulary.of([bytes([int(n[3:-1], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names])
        self.seen = Recent(REMEMBERED)
        most = max(len(self.bpe.words), len(names))
        #: Decimal numbers, each with a place for a mark behind it.
        self.decimals = Vocabulary.of([b"%d," % i for i in range(most)])

    @classmethod
    def of(cls, paths: tuple[str, str, str]) -> TwoTokenizers:
        """One for each pair of files in a worker process, which tasks share."""
        if paths not in TOKENIZERS:
            TOKENIZERS[paths] = cls(*paths)
        return TOKENIZERS[paths]

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """Piece ids of new units. Encoding puts a space before a text: it stands for a unit's own one, or is dropped again."""
        spaced = [u[1:] if u[0] == " " else u for u in units]
        ids = self.pieces.encode(spaced, num_threads=1)
        found = {u: np.array(x if u[0] == " " else x[1:], np.int32).tobytes() for u, x in zip(units, ids, strict=True)}
        self.seen.add(found)
        return found

    def encode(self, texts: list[list[str]]) -> tuple[list[bytes], list[bytes]]:
        """Lists of units -> the ids of each by the one and the other, as bytes of 32-bit integers."""
        got = [list(map(self.seen.__getitem__, some)) for some in texts]
        new = {u for some, ids in zip(texts, got, strict=True) for u, x in zip(some, ids, strict=True) if x is None}
        if new:
            found = self.learn(list(new))
            got = [[found[u] if x is None else x for u, x in zip(some, ids, strict=True)] for some, ids in zip(texts, got, strict=True)]
        return self.bpe.joined(texts), [b"".join(x) for x in got]

    def units(self, text: str) -> list[str]:
        return UNIT.findall(text) if self.cuts else [text]


#: One for each pair of files in a worker process, which tasks share.
TOKENIZERS: dict[tuple[str, str, str], TwoTokenizers] = {}


@dataclass
class Tokens:
    """Tokens of both tokenizers over the same bytes: ids, and the byte behind each token's last."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    @classmethod
    def none(cls) -> Tokens:
        return cls(*(np.zeros(0, np.int64) for _ in range(4)))

    def between(self, lo: int, hi: int) -> Tokens:
        """The tokens that end behind lo and at or before hi."""
        i, j = np.searchsorted(self.a_end, [lo, hi], side="right")
        k, m = np.searchsorted(self.b_end, [lo, hi], side="right")
        return Tokens(self.a[i:j], self.a_end[i:j], self.b[k:m], self.b_end[k:m])

    def then(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([getattr(self, f.name), getattr(other, f.name)]) for f in fields(self)))

    def __len__(self) -> int:
        return len(self.a) + len(self.b)


@dataclass
class Fragment:
    """What a byte range says of the groups. Without a common end (cut is false) all of its tokens are in the prefix."""

    prefix: Tokens
    closed: list[Tokens]
    suffix: Tokens
    cut: bool

    @classmethod
    def of(cls, t: Tokens) -> Fragment:
        common = np.intersect1d(t.a_end, t.b_end, assume_unique=True)
        if not len(common):
            return cls(t, [], Tokens.none(), False)
        first, last, end = int(common[0]), int(common[-1]), 1 << 62
        return cls(t.between(-1, first), [t.between(first, last)] if last > first else [], t.between(last, end), True)

    def then(self, other: Fragment) -> Fragment:
        """The fragment of this range and the next; Fragment.of(Tokens.none()) changes nothing."""
        if not self.cut:
            return Fragment(self.prefix.then(other.prefix), other.closed, other.suffix, other.cut)
        if not other.cut:
            return Fragment(self.prefix, self.closed, self.suffix.then(other.prefix), True)
        return Fragment(self.prefix, [*self.closed, self.suffix.then(other.prefix), *other.closed], other.suffix, True)


def composed(fragments: list[Fragment]) -> Fragment:
    """All of them in order, pairwise."""
    while len(fragments) > 1:
        fragments = [fragments[i].then(fragments[i + 1]) if i + 1 < len(fragments) else fragments[i] for i in range(0, len(fragments), 2)]
    return fragments[0] if fragments else Fragment.of(Tokens.none())


@dataclass
class Closed:
    """Closed groups of several texts, which lie end to end: counts by text, groups as text with a mark behind each, different pairs and how often each."""

    counts: dict[str, np.ndarray]
    groups: list[bytes]
    pair_ends: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def close(t: Tokens, ends: np.ndarray, base: int, two: TwoTokenizers) -> Closed:
    """t: whole groups from byte base on; ends: the byte behind each text. Links are the stretches between neighbouring ends of any token."""
    size = int(ends[-1]) - base if len(ends) else 0
    mark = np.zeros(size + 1, np.uint8)
    a_end, b_end, ends = t.a_end - base, t.b_end - base, ends - base
    mark[a_end] |= 1
    mark[b_end] |= 2
    n_a, n_b, n_common, n_links = (np.cumsum(x, dtype=np.int32) for x in (mark & 1, mark >> 1, mark == 3, mark > 0))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    counts = {k: (v[ends] - v[starts]).astype(np.int64) for k, v in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_common), ("n_links", n_links))}
    # links: the tokens over each stretch
    stop = np.flatnonzero(mark)
    pair = t.a[n_a[stop - 1]].astype(np.int64) * len(two.b.offsets) + t.b[n_b[stop - 1]]
    of = np.repeat(np.arange(len(ends)), counts["n_links"])
    span = len(two.a.offsets) * len(two.b.offsets)
    keys, times = np.unique(of * span + pair, return_counts=True)
    # groups as text: a group's tokens of the one, then of the other
    common = np.concatenate([[0], np.flatnonzero(mark == 3)])
    place_a = np.arange(len(t.a)) + n_b[common[n_common[a_end - 1]]]
    place_b = np.arange(len(t.b)) + n_a[common[n_common[b_end - 1] + 1]] if len(t.b) else np.zeros(0, np.int64)
    ids, marks = np.zeros(len(t), np.int64), np.zeros(len(t), np.uint8)
    ids[place_a], ids[place_b] = t.a, t.b
    marks[place_a] = np.where(mark[a_end] == 3, ord("|"), ord(","))
    marks[place_b] = np.where(mark[b_end] == 3, ord(";"), ord(","))
    text = gathered(ids, two.decimals.data, two.decimals.offsets)
    at = np.cumsum(two.decimals.sizes(ids))
    text[at - 1] = marks
    stops = np.concatenate([[0], at])[np.cumsum(counts["n_a"] + counts["n_b"])].tolist() if len(ends) else []
    raw = text.tobytes()
    return Closed(counts, [raw[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)], np.searchsorted(keys, (np.arange(len(ends)) + 1) * span), keys % span, times)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
CLOSED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups binary, pairs array<long>, times array<int>"
SHORT = CLOSED.replace("groups binary", "groups_sha256 string")
OPEN = ", ".join(f"{side}_{f} array<long>" for side in ("prefix", "suffix") for f in ("a", "a_end", "b", "b_end"))
FRAGMENT = f"row long, at long, pos long, ok boolean, cut boolean, {OPEN}, n_a long, n_b long, n_groups long, n_links long, groups binary, pairs array<long>, times array<int>"


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


def same_bytes(ids: np.ndarray, of: Vocabulary, data: np.ndarray) -> bool:
    return int(of.sizes(ids).sum()) == len(data) and bool((gathered(ids, of.data, of.offsets) == data).all())


def align_short(docs: DataFrame, paths: tuple[str, str, str]) -> DataFrame:
    """row, doc_id, text -> SHORT: a document is one range here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = TwoTokenizers.of(paths)
        for batch in batches:
            for some in portions(batch, 2, SLICE):
                data, offsets = utf8(some.column(2))
                a, b = two.encode([two.units(" " + t) if t else [] for t in some.column(2).to_pylist()])
                a, b = [np.frombuffer(x, np.int32) for x in a], [np.frombuffer(x, np.int32) for x in b]
                spaced = [np.concatenate([[32], data[i:j]]).astype(np.uint8) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                good = [len(x) > 1 and same_bytes(i, two.a, x) and same_bytes(j, two.b, x) for x, i, j in zip(spaced, a, b, strict=True)]
                sizes = np.array([len(x) if g else 0 for x, g in zip(spaced, good, strict=True)], np.int64)
                flat_a = np.concatenate([np.zeros(0, np.int32), *(x for x, g in zip(a, good, strict=True) if g)])
                flat_b = np.concatenate([np.zeros(0, np.int32), *(x for x, g in zip(b, good, strict=True) if g)])
                t = Tokens(flat_a, np.cumsum(two.a.sizes(flat_a)), flat_b, np.cumsum(two.b.sizes(flat_b)))
                c = close(t, np.cumsum(sizes), 0, two)
                digests = [hashlib.sha256(g[:-1]).hexdigest() if g else "" for g in c.groups]
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), *(pa.array(c.counts[k]) for k in COUNTS), pa.array(digests, pa.string()), lists(c.pairs, c.pair_ends, pa.int64()), lists(c.times, c.pair_ends, pa.int32()),
                ], [f.split(" ")[0] for f in SHORT.split(", ")])

    return docs.mapInArrow(run, SHORT)


def cut_long(docs: DataFrame, paths: tuple[str, str, str]) -> DataFrame:
    """row, doc_id, text -> row, doc_id, start, part (text): space+text in parts that end before white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = TwoTokenizers.of(paths).cuts
        for batch in batches:
            for row, doc, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                text, at, start = " " + text.as_py(), 0, 0
                while at < len(text):
                    found = GAP.search(text, at + PART) if cuts else None
                    part = text[at : found.start() if found else len(text)]
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()]), pa.array([doc.as_py()], pa.int64()), pa.array([start]), pa.array([part])], ["row", "doc_id", "start", "part"])
                    at, start = at + len(part), start + len(part.encode())

    return docs.mapInArrow(run, "row long, doc_id long, start long, part string")


def fragment_rows(row: int, at: int, pos: int, f: Fragment, two: TwoTokenizers) -> list[dict[str, object]]:
    """A row for a fragment's open ends, and one without `at` for each stretch of closed groups."""
    out: dict[str, object] = {"row": row, "at": at, "pos": pos, "ok": True, "cut": f.cut}
    for side in ("prefix", "suffix"):
        out |= {f"{side}_{k.name}": getattr(getattr(f, side), k.name) for k in fields(Tokens)}
    return [out, *closed_rows(row, f.closed, two)]


def closed_rows(row: int, closed: list[Tokens], two: TwoTokenizers) -> list[dict[str, object]]:
    out = []
    for t in closed:
        base = int(min(t.a_end[0] - two.a.sizes(t.a[:1])[0], t.b_end[0] - two.b.sizes(t.b[:1])[0]))
        c = close(t, t.a_end[-1:], base, two)
        out.append({"row": row, "pos": base, "ok": True} | {k: int(v[0]) for k, v in c.counts.items()} | {"groups": c.groups[0], "pairs": c.pairs, "times": c.times})
    return out


def batch_of(rows: list[dict[str, object]]) -> pa.RecordBatch:
    names = [f.rsplit(" ", 1) for f in FRAGMENT.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in names], [n for n, _ in names])


def fragments(parts: DataFrame, paths: tuple[str, str, str]) -> DataFrame:
    """row, start, part -> FRAGMENT: a row for each byte range of a part. A part that a tokenizer does not give back has one row that is not ok."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = TwoTokenizers.of(paths)
        for batch in batches:
            for row, start, part in zip(*(batch.column(c).to_pylist() for c in ("row", "start", "part")), strict=True):
                found, a, b = (UNIT.finditer(part) if two.cuts else re.finditer(r"(?s).+", part)), [], []
                while some := [m.group() for m in itertools.islice(found, UNITS_AT_ONCE)]:
                    x, y = two.encode([some])
                    a, b = a + x, b + y
                ia, ib = np.frombuffer(b"".join(a), np.int32), np.frombuffer(b"".join(b), np.int32)
                data = np.frombuffer(part.encode(), np.uint8)
                if not same_bytes(ia, two.a, data) or not same_bytes(ib, two.b, data):
                    yield batch_of([{"row": row, "at": 0, "pos": start, "ok": False, "cut": False}])
                    continue
                t = Tokens(ia.astype(np.int64), start + np.cumsum(two.a.sizes(ia)), ib.astype(np.int64), start + np.cumsum(two.b.sizes(ib)))
                for lo in range(start // RANGE * RANGE, start + len(data), RANGE):
                    f = Fragment.of(t.between(max(lo, start), lo + RANGE))
                    yield batch_of(fragment_rows(row, 2 * (lo // RANGE) + (start > lo), max(lo, start), f, two))

    return parts.select("row", "start", "part").mapInArrow(run, FRAGMENT)


def compose_round(opened: DataFrame, paths: tuple[str, str, str], last: bool) -> DataFrame:
    """FRAGMENT -> FRAGMENT: FAN neighbours in one. last: a row is a whole document, and what is open at its ends is closed."""

    def of(r: dict) -> Fragment:
        prefix, suffix = (Tokens(*(np.array(r[f"{s}_{f.name}"] or [], np.int64) for f in fields(Tokens))) for s in ("prefix", "suffix"))
        return Fragment(prefix, [], suffix, r["cut"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = TwoTokenizers.of(paths)

        def done(key: tuple[int, int], pos: int, some: list[Fragment]) -> pa.RecordBatch:
            f = composed(some)
            if last:
                return batch_of(closed_rows(key[0], [x for x in (f.prefix, *f.closed, f.suffix) if len(x)], two))
            return batch_of(fragment_rows(*key, pos, f, two))

        key, pos, some = None, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                now = (r["row"], r["at"] // FAN)
                if now != key:
                    if key is not None:
                        yield done(key, pos, some)
                    key, pos, some = now, r["pos"], []
                some.append(of(r))
        if key is not None:
            yield done(key, pos, some)

    near = opened.filter("at IS NOT NULL AND ok").drop("groups", "pairs", "times").withColumn("__to", F.floor(F.col("at") / FAN)).repartition("row", "__to")
    return near.sortWithinPartitions("row", "at", "pos").drop("__to").mapInArrow(run, FRAGMENT)


def align_long(docs: DataFrame, paths: tuple[str, str, str]) -> DataFrame | None:
    """row, doc_id, text -> CLOSED rows (one or more a document; in order by pos), or None if there are no documents."""
    parts = materialize(cut_long(docs, paths))
    found = [materialize(fragments(parts.repartition("row", "start"), paths))]
    reach = found[0].agg(F.max("at").alias("m")).first()["m"]
    if reach is None:
        return None
    last = False
    while not last:
        last, reach = reach < FAN, reach // FAN
        found.append(materialize(compose_round(found[-1], paths, last)))
    rows = parts.select("row", "doc_id").distinct()
    bad = found[0].filter("NOT ok").select("row").distinct()
    closed = None
    for f in found:
        f = f.filter("groups IS NOT NULL").select("row", "pos", *COUNTS, "groups", "pairs", "times")
        closed = f if closed is None else closed.unionByName(f)
    return rows.join(closed.join(bad, "row", "left_anti"), "row", "left")


def long_digests(closed: DataFrame) -> DataFrame:
    """row, groups_sha256 from the closed groups in order; a document is digested as it streams by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([row]), pa.array([sha.hexdigest()])], ["row", "groups_sha256"])

        row, sha, gap = None, None, False
        for batch in batches:
            for r, groups in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if r != row:
                    if row is not None:
                        yield out()
                    row, sha, gap = r, hashlib.sha256(), False
                if gap:
                    sha.update(b";")
                sha.update(memoryview(groups.as_buffer())[:-1])
                gap = True
        if row is not None:
            yield out()

    return closed.filter("groups IS NOT NULL").select("row", "pos", "groups").repartition("row").sortWithinPartitions("row", "pos").mapInArrow(run, "row long, groups_sha256 string")


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """pairs, times -> pair, n (over all rows), best (n is the highest of the pair's second id)."""
    each = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.*")
    n = materialize(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")))
    top = n.groupBy((F.col("pair") % width).alias("second")).agg(F.max("n").alias("top"))
    return n.withColumn("second", F.col("pair") % width).join(top, "second").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def with_counts(found: DataFrame, counts: DataFrame) -> DataFrame:
    """row, pairs, times -> row, n_best, count_sum."""
    counts = materialize(counts)
    if counts.count() > SENT_PAIRS:
        each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), "p.times").join(counts, "pair")
        return each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).cast("long").alias("count_sum"))
    known = counts.select("pair", (F.col("n") * 2 + F.col("best").cast("int")).alias("x")).toArrow()
    pair, x = (known.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(pair)
    with sent(found, (Packed(pair[order]), Packed(x[order]))) as table_of:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, x = (p.array() for p in table_of.value)
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    some = batch.slice(at, 500)
                    n = pc.list_value_length(some.column(1)).fill_null(0).to_numpy()
                    keys, times = (pc.list_flatten(some.column(i)).to_numpy() for i in (1, 2))
                    got = x[np.searchsorted(pair, keys)] if len(keys) else np.zeros(0, np.int64)
                    sums = [np.concatenate([[0], np.cumsum(v)]) for v in ((got & 1) * times, (got >> 1) * times)]
                    ends = np.concatenate([[0], np.cumsum(n)])
                    yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(np.diff(s[ends])) for s in sums)], ["row", "n_best", "count_sum"])

        return materialize(found.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long"))


def align(docs: DataFrame, byte_level: str, piece_model: str, pattern: str) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; a row for each row.

    The one tokenizer encodes space+text, the other the text (before which it puts a space). A link is a pair of overlapping tokens; n_best counts those whose
    pair is linked most often of all with its second id, over all documents (ties count), count_sum sums how often their pairs are. A null or empty text, or one
    that the tokens of either do not give back, has zeros and no digest. Repeated rows count as often as they stand there. Other columns are left out.
    """
    paths = (byte_level, piece_model, pattern)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    is_long = F.coalesce(F.char_length("text"), F.lit(0)) > LONG
    short = materialize(align_short(rows.filter(~is_long), paths))
    width = len(TwoTokenizers.of(paths).b.offsets)
    long = align_long(rows.filter(is_long).withColumn("row", -1 - F.col("row")), paths)
    found = short.select("row", "pairs", "times")
    if long is not None:
        long = materialize(long)
        found = found.unionByName(long.select("row", "pairs", "times"))
    sums = with_counts(found, pair_counts(found, width))
    zero = lambda *names: {n: F.coalesce(n, F.lit(0).cast("long")) for n in names}
    head = short.drop("pairs", "times")
    if long is not None:
        total = long.groupBy("row", "doc_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS))
        head = head.unionByName(total.join(long_digests(long), "row", "left").withColumn("groups_sha256", F.coalesce("groups_sha256", F.lit(""))))
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return head.join(sums, "row", "left").withColumns(zero("n_best", "count_sum")).select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
