"""Benchmark decontamination by greedy string tiling (Wise's running Karp-Rabin form).

Documents and test items that share a run of min_match tokens (a seed) are joined. The tokens of an item that its shared seeds cover bound
what tiles can cover, so only pairs whose bound reaches the threshold are tiled: the longest match of tokens not yet used on either side is
marked, again and again, whatever the order of the passages; a pair whose tiles cover enough of the item is a leak.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_table, in_bits, materialize, sent, table
from .tokens import grams, lowered, tokenize

MIN_MATCH = 4
THRESHOLD = 0.5
#: Candidate pairs up to this many (ids only) are sent to all tasks; more are joined by shuffle.
SENT_PAIRS = 200_000

TILE_SCHEMA = "doc_id long, item_id long, n_item_tokens int, n_matched int, n_tiles int, longest int, coverage double"


def text_tokens(text: str | None) -> list[bytes]:
    (_, data, offsets), *_ = lowered(pa.array([text or ""]))
    _, _, start, end = tokenize(data, offsets)
    whole = data.tobytes()
    return [whole[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]


def _free_runs(used: list[bool]) -> Iterator[tuple[int, int]]:
    start = None
    for i, u in enumerate([*used, True]):
        if u and start is not None:
            yield start, i
            start = None
        elif not u and start is None:
            start = i


def _hashes(x: list[int], used: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of the windows of s unused tokens."""
    base, mod = 1_000_003, (1 << 61) - 1
    top = pow(base, s - 1, mod)
    for a, b in _free_runs(used):
        if b - a < s:
            continue
        h = 0
        for v in x[a : a + s]:
            h = (h * base + v + 1) % mod
        yield a, h
        for i in range(a + s, b):
            h = ((h - (x[i - s] + 1) * top) * base + x[i] + 1) % mod
            yield i - s + 1, h


def greedy_tiles(item: list, doc: list, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length) of at least min_match tokens, longest first, none overlapping on either side."""
    code: dict = {}
    p, t = [code.setdefault(x, len(code)) for x in item], [code.get(x, -1) for x in doc]
    free_p, free_t = [False] * len(p), [x < 0 for x in t]  # tokens that the item lacks are as good as used
    tiles: list[tuple[int, int, int]] = []
    s = max(min_match, min(len(p), 20))
    while min_match <= len(p):
        by_hash = defaultdict(list)
        for at, h in _hashes(t, free_t, s):
            by_hash[h].append(at)
        found, longest = [], 0
        for at, h in _hashes(p, free_p, s):
            for to in by_hash.get(h, ()):
                n = 0
                while at + n < len(p) and to + n < len(t) and p[at + n] == t[to + n] and not free_p[at + n] and not free_t[to + n]:
                    n += 1
                if n >= s:
                    found.append((n, at, to))
                    longest = max(longest, n)
            if longest > 2 * s:
                break
        if longest > 2 * s:
            s = longest
            continue
        queue = [(-n, at, to) for n, at, to in found]
        heapify(queue)
        while queue:
            n, at, to = heappop(queue)
            clear = [not free_p[at + i] and not free_t[to + i] for i in range(-n)]
            if all(clear):
                tiles.append((at, to, -n))
                for i in range(-n):
                    free_p[at + i] = free_t[to + i] = True
                continue
            for a, b in _free_runs([not c for c in clear]):
                if b - a >= s:
                    heappush(queue, (a - b, at + a, to + a))
        if s <= min_match:
            break
        s = max(min_match, s // 2)
    return tiles


def benchmark_seeds(items: DataFrame, min_match: int = MIN_MATCH) -> DataFrame:
    """item_id, text -> item_id, n (its tokens), k (tokens in a seed: min_match, or all of a shorter item), pos, seed. Items without tokens have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, offsets in lowered(b.column(1)):
                h, doc, _, _ = tokenize(data, offsets)
                n = np.bincount(doc, minlength=len(offsets) - 1)
                ids = b.column(0).slice(row, len(offsets) - 1)
                for k in range(1, min_match + 1):
                    g, at = grams(h, doc, k)
                    mine = (n[doc[at]] >= k) if k == min_match else (n[doc[at]] == k)
                    g, at = g[mine], at[mine]
                    first = np.cumsum(n) - n
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[at])), pa.array(n[doc[at]].astype(np.int32)), pa.array(np.full(len(g), k, np.int32)), pa.array((at - first[doc[at]]).astype(np.int32)), pa.array(g.view(np.int64))], ["item_id", "n", "k", "pos", "seed"])

    return items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, n int, k int, pos int, seed long")


def shared_seeds(docs: DataFrame, lengths: list[int], sent: Broadcast) -> DataFrame:
    """doc_id, text -> doc_id, k, seed: the document's distinct seeds that the bit table may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, offsets in lowered(b.column(1), 1 << 20):
                h, doc, _, _ = tokenize(data, offsets)
                ids = b.column(0).slice(row, len(offsets) - 1)
                for k in lengths:
                    g, at = grams(h, doc, k)
                    held = in_bits(sent.value, g.view(np.int64))
                    g, at = g[held], at[held]
                    pair = np.unique(np.rec.fromarrays([doc[at], g], names="d,g"))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.ascontiguousarray(pair.d))), pa.array(np.full(len(pair), k, np.int32)), pa.array(np.ascontiguousarray(pair.g).view(np.int64))], ["doc_id", "k", "seed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, k int, seed long")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> a row of TILE_SCHEMA for each pair whose tiles cover at least threshold of the item's tokens.

    Null and empty texts, and items without an id, give no pair. Repeated documents give a row each; repeated items count once. Other columns
    are not looked at. A document without an id is matched like others and has a null doc_id. Empty tables give an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    items = items.select(F.col("item_id").cast("long"), "text").dropDuplicates()
    seeds = materialize(benchmark_seeds(items, min_match))
    lengths = sorted(r["k"] for r in seeds.select("k").distinct().collect())
    covered = F.aggregate(
        F.col("pos"), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["sum"] + x + F.col("k") - F.greatest(x, a["end"])).alias("sum"), (x + F.col("k")).alias("end")),
    )["sum"]
    with sent(docs, bit_table(seeds.select("seed"))) as bits:
        hits = shared_seeds(docs, lengths, bits).join(seeds, ["k", "seed"])
        spans = hits.groupBy("doc_id", "item_id", "n", "k").agg(F.sort_array(F.collect_set("pos")).alias("pos"))
        pairs = materialize(spans.filter(covered >= F.lit(threshold) * F.col("n")).select("doc_id", "item_id").distinct())
    few = pairs.count() <= SENT_PAIRS
    wanted = F.broadcast(pairs) if few else pairs
    rows = docs.withColumnRenamed("doc_id", "__d").join(wanted, F.col("__d").eqNullSafe(F.col("doc_id"))).drop("__d")
    rows = rows.join(items.withColumnRenamed("text", "item"), "item_id").select("doc_id", "item_id", "text", "item")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                item = text_tokens(r["item"])
                found = greedy_tiles(item, text_tokens(r["text"]), min(min_match, len(item)))
                n = sum(x[2] for x in found)
                if n and n >= threshold * len(item):
                    out.append({"doc_id": r["doc_id"], "item_id": r["item_id"], "n_item_tokens": len(item), "n_matched": n, "n_tiles": len(found), "longest": max(x[2] for x in found), "coverage": n / len(item)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.int32()) for c in ("n_item_tokens", "n_matched", "n_tiles", "longest")), ("coverage", pa.float64())]))

    return rows.mapInArrow(tile, TILE_SCHEMA)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
