"""Removal of repeated byte strings over all documents, by sorting suffixes.

A string of LENGTH bytes is repeated if it also starts earlier: in a document before, or earlier in the same one. All bytes that repeated strings
cover are removed.

Strings are sorted where they can be equal, not all in one place. Each string has an anchor: the run of GRAM bytes in it with the least hash,
the leftmost of these. Equal strings have equal anchors at equal offsets, and neighbouring strings mostly share theirs; a maximal stretch of
starts with one anchor is an item, some 35 starts. Items are grouped by their anchor's hash. An item equal to an earlier one (in two 64-bit hashes) is a copy
of its suffixes, and repeated as a whole. The different items of a group may still share strings: their bytes are fetched and the suffixes at their
starts are sorted, deep-shallow (Manzini and Ferragina, 2004): multikey quicksort to SHALLOW bytes, all groups at once, then a blind trie orders each
group that still agrees. Neighbours in that order which agree in LENGTH bytes are one string; all but the first in place are repeated.

Anchors travel in compressed blocks, one for each task and bucket of hashes; items that a task has twice are settled in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, utf8
from .tokens import BYTE, U, mix

LENGTH = 100
GRAM = 32
STARTS = LENGTH - GRAM + 1
#: Bytes sorted by multikey quicksort before blind tries take over.
SHALLOW = 32
#: Bytes of text a task works on at once (more only for one longer text), and items it holds before it sends them.
AT_ONCE = 1 << 20
HELD_ITEMS = 1 << 19
#: Buckets for each shuffle partition.
BUCKETS_PER_PARTITION = 4
NULL_ID = -(1 << 63)

STEP = [U(pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64)) for i in range(7)]
ITEM = [("key", "<u8"), ("item", "<u8"), ("item2", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i4"), ("more", "<u1"), ("lead", "<u1")]
SPAN = "doc long, row long, start int, end int, key long, lead int"


def doubled(data: np.ndarray) -> list[np.ndarray]:
    """Hashes of the runs of 1, 2, 4, ... 64 bytes from each place (shorter at the end of data)."""
    g = [BYTE[data]]
    for i in range(6):
        n = 1 << i
        g.append(g[-1][:-n] * STEP[i] + g[-1][n:] if len(g[-1]) > n else np.zeros(0, U))
    return g


def long_hash(g: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Hash of the LENGTH bytes (64 + 32 + 4) at each place."""
    return mix(mix(mix(g[6][at]) + g[5][at + 64]) * STEP[0] + g[2][at + 96])


def second_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Another hash of the bytes between start and end (8 or more, and 8 * 21 at most), read as words of eight that may overlap at the end."""
    words = np.ndarray((len(data) - 7,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    h = (end - start).astype(U)
    for i in range(-(-(2 * LENGTH - GRAM) // 8)):
        h = (h ^ words[np.minimum(start + 8 * i, end - 8)]) * U(0x9FB21C651E98DF25)
        h ^= h >> U(29)
    return h


def items_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The items of texts end to end: text's index, start in data, more (starts after the first), lead (bytes from start to anchor), key, item, item2."""
    empty = {c: np.zeros(0, np.int64) for c in ("text", "start", "more", "lead")} | {c: np.zeros(0, U) for c in ("key", "item", "item2")}
    n = len(data) - LENGTH + 1
    if n <= 0:
        return empty
    g = doubled(data)
    h = mix(g[5])
    low = max(1, int(len(data)).bit_length())
    v = (h >> U(low) << U(low)) | np.arange(len(h), dtype=U)
    blocks = -(-len(v) // STARTS)
    v = np.concatenate([v, np.full(blocks * STARTS - len(v), np.iinfo(U).max)]).reshape(blocks, STARTS)
    left = np.minimum.accumulate(v, axis=1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(right[:n], left[STARTS - 1 : STARTS - 1 + n]) & U((1 << low) - 1)).astype(np.int64)
    size = np.maximum(0, np.diff(offsets) - LENGTH + 1)
    text = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + offsets[:-1][text]
    if not len(at):
        return empty
    a = anchor[at]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (text[1:] != text[:-1])])
    more = np.diff(np.r_[first, len(at)]) - 1
    start, a = at[first], a[first]
    lead = a - start
    item = mix(long_hash(g, start) * STEP[1] + long_hash(g, start + more) + ((more << 8) | lead).astype(U))
    return {"text": text[first], "start": start, "more": more, "lead": lead, "key": h[a], "item": item, "item2": second_hash(data, start, start + more + LENGTH)}


def settle(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Items in order of key, item, place; and which are equal to the one before (what differs in item2 alone is left to the sort)."""
    order = np.lexsort((x["start"], x["row"], x["doc"], x["item"], x["key"]))
    x = {c: v[order] for c, v in x.items()}
    again = np.zeros(len(order), bool)
    again[1:] = np.all([x[c][1:] == x[c][:-1] for c in ("key", "item", "item2")], axis=0)
    return x, again


def packed(x: dict[str, np.ndarray]) -> bytes:
    raw = b"".join(np.ascontiguousarray(x[c].astype(t)).tobytes() for c, t in ITEM)
    return len(x["key"]).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 0, {}
    raw = pa.decompress(blob[8:], n * sum(np.dtype(t).itemsize for _, t in ITEM), "zstd", asbytes=True)
    for c, t in ITEM:
        size = n * np.dtype(t).itemsize
        out[c], at = np.frombuffer(raw[at : at + size], t), at + size
    return out


def slices(column: pa.Array, at_once: int = AT_ONCE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + at_once, side="right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def _rows(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray | None = None, lead: np.ndarray | None = None) -> pa.RecordBatch:
    """A batch of SPAN; without key, spans to remove; with one, items to fetch."""
    none = np.ones(len(doc), bool) if key is None else None
    key, lead = (np.zeros(len(doc), np.int64),) * 2 if key is None else (key, lead)
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(row.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(key.view(np.int64), mask=none), pa.array(lead.astype(np.int32), mask=none)], ["doc", "row", "start", "end", "key", "lead"])


def blocks_of_items(docs: DataFrame, buckets: int) -> DataFrame:
    """docs: doc, row, text -> bucket, items, gone: a task's items by bucket of the key's hash; those it settled, by bucket of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            x, again = settle({c: np.concatenate([h[c] for h in held]) for c in held[0]})
            held.clear()
            for kind, mine in (("items", ~again), ("gone", again)):
                y = {c: v[mine] for c, v in x.items()}
                bucket = ((y["key"] if kind == "items" else mix(y["doc"].view(U))) % U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                y, bucket = {c: v[order] for c, v in y.items()}, bucket[order]
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    blob = packed({c: v[cuts[b] : cuts[b + 1]] for c, v in y.items()})
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "items": pa.array([blob if kind == "items" else None], pa.binary()), "gone": pa.array([blob if kind == "gone" else None], pa.binary())})

        for b in batches:
            doc, row = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at, data, offsets in slices(b.column(2)):
                x = items_of(data, offsets)
                text = x.pop("text")
                x["start"] = x["start"] - offsets[text]
                held.append(x | {"doc": doc[at + text], "row": row[at + text]})
                if sum(len(h["key"]) for h in held) >= HELD_ITEMS:
                    yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(run, "bucket int, items binary, gone binary")


def settled(blocks: DataFrame, partitions: int) -> DataFrame:
    """Rows of SPAN: spans to remove (key null), and items to fetch whose group has different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            x, again = settle({c: np.concatenate([h[c] for h in held]) for c, _ in ITEM})
            held.clear()
            end = x["start"] + x["more"].astype(np.int64) + LENGTH
            yield _rows(x["doc"][again], x["row"][again], x["start"][again], end[again])
            one = ~again
            y, end = {c: v[one] for c, v in x.items()}, end[one]
            same = y["key"][1:] == y["key"][:-1]
            many = np.r_[False, same] | np.r_[same, False]
            yield _rows(*(y[c][many] for c in ("doc", "row", "start")), end[many], y["key"][many], y["lead"][many])

        for b in batches:  # sorted by bucket
            for bucket, items, gone in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if held and bucket != now:
                    yield from flush()
                now = bucket
                if items.is_valid:
                    held.append(unpacked(items.as_py()))
                else:
                    x = unpacked(gone.as_py())
                    yield _rows(x["doc"], x["row"], x["start"], x["start"] + x["more"].astype(np.int64) + LENGTH)
        if held:
            yield from flush()

    return blocks.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, SPAN)


class BlindTrie:
    """Strings of equal length, in a trie that keeps only branching depths; a search goes down unseen bytes and compares with one leaf."""

    def __init__(self) -> None:
        self.root: list | int | None = None
        self.strings: list[bytes] = []
        self.members: list[list[int]] = []

    def insert(self, s: bytes, member: int) -> None:
        node = self.root
        while isinstance(node, list):  # [depth, {byte: node}]
            child = node[1].get(s[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        other = None if node is None else self.strings[node]
        if other == s:
            self.members[node].append(member)
            return
        new = len(self.strings)
        self.strings.append(s)
        self.members.append([member])
        if other is None:
            self.root = new
            return
        lo, hi = 0, len(s)
        while hi - lo > 1:  # length of the common prefix
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if s[:mid] == other[:mid] else (lo, mid)
        parent, node, edge = None, self.root, None
        while isinstance(node, list) and node[0] < lo:
            parent, edge, node = node, s[node[0]], node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == lo:
            node[1][s[lo]] = new
            return
        branch = [lo, {other[lo]: node, s[lo]: new}]
        if parent is None:
            self.root = branch
        else:
            parent[1][edge] = branch

    def ordered(self) -> list[list[int]]:
        """The members of each different string, in the strings' order."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(self.members[node])
        return out


def multikey_quicksort(text: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of text at `at` in order of group and of their first SHALLOW bytes (a stable order), and where (from, to) several still agree.

    All parts of all groups are split at once, about the median of three words of eight bytes each: into less, equal and greater. The equal go on
    with the next word.
    """
    order = np.argsort(group, kind="stable")
    g = group[order]
    cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]) if len(g) else np.zeros(1, np.int64)
    lo, hi, depth = cuts[:-1], cuts[1:], np.zeros(len(cuts) - 1, np.int64)
    deep = []
    while True:
        open_ = hi - lo > 1
        done = open_ & (depth >= SHALLOW)
        deep.append(np.stack([lo[done], hi[done]]))
        open_ &= ~done
        lo, hi, depth = lo[open_], hi[open_], depth[open_]
        if not len(lo):
            break
        size = hi - lo
        first = np.cumsum(size) - size
        part = np.repeat(np.arange(len(lo)), size)
        place = np.arange(len(part)) - (first - lo)[part]
        suffix = order[place]
        byte = at[suffix] + depth[part]
        word = np.zeros(len(part), U)
        for j in range(8):
            word = (word << U(8)) | text[byte + j].astype(U)
        a, b, c = word[first], word[first + size // 2], word[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]
        less, more = word < pivot, word > pivot
        same = ~(less | more)
        n = [np.add.reduceat(x, first, dtype=np.int64) for x in (less, same)]
        shift = [np.zeros(len(lo), np.int64), n[0], n[0] + n[1]]
        to = np.empty(len(part), np.int64)
        for x, move in zip((less, same, more), shift, strict=True):
            count = np.cumsum(x)
            to[x] = (lo + move - (count[first] - x[first]))[part[x]] + count[x] - 1
        order[to] = suffix
        lo, hi = np.concatenate([lo + m for m in shift]), np.concatenate([lo + n[0], lo + n[0] + n[1], hi])
        depth = np.concatenate([depth, depth + 8, depth])
    return order, *np.concatenate(deep, axis=1)


def sorted_suffixes(text: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of text at `at` in order of group and of their next LENGTH bytes, equal ones in the given order; and which are equal to the one before."""
    order, lo, hi = multikey_quicksort(text, at, group)
    same = np.zeros(len(order), bool)
    raw = text.tobytes() if len(lo) else b""
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        trie = BlindTrie()
        for i in order[a:b].tolist():
            s = int(at[i])
            trie.insert(raw[s + SHALLOW : s + LENGTH], i)
        for members in trie.ordered():
            order[a : a + len(members)] = members
            same[a + 1 : a + len(members)] = True
            a += len(members)
    return order, same


def equal_strings(text: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Numbers for the suffixes of text at `at`, in their order: equal if and only if group and the next LENGTH bytes are."""
    order, same = sorted_suffixes(text, at, group)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(~same) - 1
    return out


def repeated_in(x: dict[str, np.ndarray], text: np.ndarray) -> np.ndarray:
    """x: items (key, doc, row, start, lead, at, size) with bytes text[at : at + size] -> (item, first offset, last offset) of the stretches of repeated starts."""
    n = x["size"] - LENGTH + 1
    item = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    # equal strings have their anchor at the same offset: compare these only
    delta = (x["lead"][item] - off).astype(np.int64)
    order = np.lexsort((x["start"][item] + off, x["row"][item], x["doc"][item], delta, x["key"][item]))
    item, off, delta = item[order], off[order], delta[order]
    key = x["key"][item]
    group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (delta[1:] != delta[:-1])]) - 1 if len(item) else item
    order, same = sorted_suffixes(text, x["at"][item] + off, group)  # equal ones stay in order of place
    again = np.zeros(len(item), bool)
    again[order[same]] = True
    item, off = item[again], off[again]
    order = np.lexsort((off, item))
    item, off = item[order], off[order]
    cut = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (off[1:] != off[:-1] + 1)]) if len(item) else np.zeros(0, np.int64)
    last = np.r_[cut[1:], len(item)] - 1 if len(cut) else cut
    return np.stack([item[cut], off[cut], off[last]]) if len(cut) else np.zeros((3, 0), np.int64)


def sorted_items(docs: DataFrame, wanted: DataFrame, partitions: int) -> DataFrame:
    """Spans repeated between different items of a group. wanted: rows of SPAN with a key."""
    asked = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "end", "key", "lead")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, row, text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if asked.is_valid:
                    raw = (text.as_py() or "").encode("utf-8")
                    a = asked.as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in a], pa.int64()), pa.array([doc] * len(a), pa.int64()), pa.array([row] * len(a), pa.int64()), pa.array([r["start"] for r in a], pa.int32()), pa.array([r["lead"] for r in a], pa.int32()), pa.array([raw[r["start"] : r["end"]] for r in a], pa.binary())], ["key", "doc", "row", "start", "lead", "bytes"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            x = {c: t[c].to_numpy() for c in ("key", "doc", "row", "start", "lead")}
            raw = t["bytes"].combine_chunks() if isinstance(t["bytes"], pa.ChunkedArray) else t["bytes"]
            raw = (raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw).cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            i, lo, hi = repeated_in(x | {"at": offsets[:-1], "size": np.diff(offsets)}, np.frombuffer(raw.buffers()[2], np.uint8))
            return _rows(x["doc"][i], x["row"][i], x["start"][i] + lo, x["start"][i] + hi + LENGTH)

        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:  # sorted by key: a group may go on in the next batch
            k = b.column(0).to_numpy()
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if rows + cut > 10_000 and held and (cut or held[-1].column(0)[-1].as_py() != k[0]):
                yield out([*held, b.slice(0, cut)])
                held, rows, b = [], 0, b.slice(cut)
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
        if held:
            yield out(held)

    texts = docs.join(asked, ["doc", "row"], "left").select("doc", "row", "text", "asked")
    items = texts.mapInArrow(fetch, "key long, doc long, row long, start int, lead int, bytes binary")
    return items.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(find, SPAN)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs: doc, row (both set), text -> rows of SPAN (key null) whose union is what is to be removed."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(settled(blocks_of_items(docs, BUCKETS_PER_PARTITION * partitions), partitions))
    return found.filter("key IS NULL").unionByName(sorted_items(docs, found.filter("key IS NOT NULL"), partitions))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_bytes, n_removed, n_spans, kept (binary).

    The order is by doc_id, null first. Rows that share a doc_id are different documents, in order of a hash of their texts. Equal rows follow each other:
    they are searched once, and all but the first lose every repeated string, which is all of a text of LENGTH bytes or more and nothing of a shorter
    one. A null text is an empty one. An empty table gives an empty result.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.col("text"))
    unique = docs.groupBy("doc").count().filter("count > 1").isEmpty()
    row = F.lit(0).cast("long") if unique else F.xxhash64("text")
    docs = docs.select("doc", row.alias("row"), "text")
    docs = docs.withColumn("n", F.lit(1).cast("long")) if unique else materialize(docs.groupBy("doc", "row", "text").agg(F.count("*").alias("n")))
    spans = repeated_spans(docs.select("doc", "row", "text")).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def batch(out: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int64()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())], list(out))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for doc, text, spans, n in zip(b.column(0).to_pylist(), b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode("utf-8")
                merged: list[list[int]] = []
                if spans.is_valid:
                    v = spans.values
                    s, e = v.field(0).to_numpy(), v.field(1).to_numpy()
                    for i in np.argsort(s, kind="stable").tolist():
                        if merged and s[i] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], int(e[i]))
                        else:
                            merged.append([int(s[i]), int(e[i])])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                for c, x in zip(out, (None if doc == NULL_ID else doc, len(raw), len(raw) - len(kept), len(merged), kept), strict=True):
                    out[c].append(x)
                gone = len(raw) >= LENGTH
                again = (None if doc == NULL_ID else doc, len(raw), len(raw) * gone, int(gone), b"" if gone else raw)
                for at in range(1, n, 10_000):
                    yield batch({c: [x] * min(10_000, n - at) for c, x in zip(out, again, strict=True)})
            yield batch(out)

    return docs.join(spans, ["doc", "row"], "left").select("doc", "row", "text", "spans", "n").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
