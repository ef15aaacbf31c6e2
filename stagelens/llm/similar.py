"""Groups of documents of Jaccard similarity 0.8 or more on five-word shingles: SimHash links first, then an exact prefix-filter join for the rest.

A document is the set of its shingles, as 64-bit hashes; documents with equal sets are one class, told apart by 128 bits, and its least id stands for it.
Classes whose SimHash fingerprints are linked by pigeonring filtering (see simhash.py) are candidates; so is, for each class, the one it shares most
prefix keys with of those that are first under a key. Those are verified and joined at once, which settles most of a large family in one candidate a class.

The rest is exact. Shingles are ordered by rarity, in a table of fixed size (see line_dedup.py), equal counts by the hash. Two sets with a similarity of
at least s share a shingle among the first n - ceil(s n) + 1 of each: those are the join keys, whatever was edited, and a pair under a key passes a length
and a positional filter. In rounds, classes of one key that no links have joined are paired with those up to MORE times as far in order of length,
until every pair under every key has been judged, filtered out, or joined by other links: no pair is left out, and candidates grow with the documents
where a family is similar. What is linked is verified: the Jaccard similarity of the sets (within a pair shingles are told apart by 32 bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Packed, bit_table, in_bits, materialize, sent
from .components import components
from .line_dedup import RARITY_PARTS, RARITY_SLOTS, rarity
from .simhash import pigeonring_links
from .tokens import U, grams, lowered, mix, tokenize

#: Places apart, on either side, of the first round's pairs under a key, and by how much each next round reaches further.
FIRST_REACH = 8
MORE = 8
SHINGLE = 5
#: Postings a task holds before it sends them, and buckets for each shuffle partition.
HELD_POSTINGS = 1 << 19
#: Bytes of text whose shingles a task works on at once.
AT_ONCE = 1 << 20
BUCKETS_PER_PARTITION = 4
#: Up to so many classes a bit table picks their documents; more are picked by a join. The rows are the same.
SENT_CLASSES = 20_000_000
#: Up to so many ids (8 bytes each) of a round's pairs are sent to where the sets are, so that only those sets move.
SENT_ENDS = 500_000
#: Of more pairs in a round, each class's best one is judged before the others.
FEW_PAIRS = 100_000

POSTING = (("key", "<u8"), ("id", "<i8"), ("n", "<i4"), ("pos", "<i4"))


#: A byte's bits, the highest first, as eight bytes.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").ravel()


class Sets:
    """The sets of shingles of a slice of texts (of the whole sequence where that is shorter), in ascending order, and two hashes of their classes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        h, doc, _, _ = tokenize(data, offsets)
        docs = len(offsets) - 1
        words = np.bincount(doc, minlength=docs)
        found = []
        for k in range(1, SHINGLE + 1):
            g, at = grams(h, doc, k)
            mine = words[doc[at]] >= k if k == SHINGLE else words[doc[at]] == k
            found.append((doc[at][mine], g[mine]))
        d, g = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.lexsort((g, d))
        d, g = d[order], g[order]
        new = np.r_[True, (d[1:] != d[:-1]) | (g[1:] != g[:-1])] if len(d) else np.zeros(0, bool)
        self.doc, self.shingle = d[new], g[new]
        self.n = np.bincount(self.doc, minlength=docs)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.data, self.offsets = data, offsets

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        cls, cls2 = np.zeros(len(self.n), U), np.zeros(len(self.n), U)
        full = np.flatnonzero(self.n)
        if len(full):
            once = mix(self.shingle)
            cls[full] = mix(np.add.reduceat(once, self.at[full]) + self.n[full].astype(U))
            cls2[full] = mix(np.add.reduceat(mix(once ^ U(0x9E3779B97F4A7C15)), self.at[full]))
        for i in np.flatnonzero(self.n == 0).tolist():  # without words, equal texts are a class
            raw = hashlib.blake2b(self.data[self.offsets[i] : self.offsets[i + 1]].tobytes(), digest_size=16).digest()
            cls[i], cls2[i] = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little")
        return cls, cls2

    def fingerprints(self) -> np.ndarray:
        """SimHash: the bits that are set in over half of a set's shingles. Each byte's bits are spread over eight lanes and summed in runs of up to 255."""
        ones = np.zeros((len(self.n), 64), np.int64)
        place = np.arange(len(self.shingle)) - self.at[self.doc]
        run = np.flatnonzero(place % 255 == 0)
        if len(run):
            doc = self.doc[run]
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            octets = self.shingle.astype(">u8").view(np.uint8).reshape(-1, 8)
            for k in range(8):
                lanes = np.add.reduceat(LANES[octets[:, k]], run).view(np.uint8).reshape(-1, 8)
                ones[doc[first], 8 * k : 8 * k + 8] = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
        return np.packbits(2 * ones > self.n[:, None], axis=1).view(">u8").astype(U).ravel()


def class_table(docs: DataFrame) -> DataFrame:
    """id, text -> two kinds of rows: id, its class (cls, cls2), n shingles and fingerprint of every document; and, with part set, a task's compressed
    counts of one part of the rarity table."""
    per = RARITY_SLOTS // RARITY_PARTS
    names = ["id", "cls", "cls2", "n", "fp", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(RARITY_SLOTS, np.uint32)
        for b in batches:
            for row, data, offsets in lowered(b.column(1), AT_ONCE):
                x = Sets(data, offsets)
                slots, n = np.unique((x.shingle % U(RARITY_SLOTS)).astype(np.int32), return_counts=True)
                seen[slots] += n.astype(np.uint32)
                longs = [pa.array(c.view(np.int64)) for c in (*x.classes(), x.fingerprints())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(x.n)), *longs[:2], pa.array(x.n.astype(np.int32)), longs[2], pa.nulls(len(x.n), pa.int32()), pa.nulls(len(x.n), pa.binary())], names)
        if seen.any():
            blobs = [pa.compress(c.astype("<u4").tobytes(), "zstd", asbytes=True) for c in seen.reshape(RARITY_PARTS, per)]
            none = [pa.nulls(RARITY_PARTS, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(np.arange(RARITY_PARTS, dtype=np.int32)), pa.array(blobs, pa.binary())], names)

    return docs.mapInArrow(run, "id long, cls long, cls2 long, n int, fp long, part int, counts binary")


def viable(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray, s: float) -> np.ndarray:
    """Whether sets of n and m shingles, whose first common one is at pos and at, can have a similarity of s."""
    return (np.minimum(n, m) >= s * np.maximum(n, m) - 1e-6) & (np.minimum(n - pos, m - at) >= s / (1 + s) * (n + m) - 1e-6)


def counted_pairs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, the greater first, and how often each is there."""
    a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
    u, v = np.maximum(a, b), np.minimum(a, b)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(u) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(u)])
    mine = u[first] != v[first]
    return u[first][mine], v[first][mine], times[mine]


#: Pairs u, v with the number of keys that gave them (key null), and postings of class u under key (v null).
MET = "u long, v long, times int, key long, n int, pos int"


def met_rows(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], postings: dict[str, np.ndarray]) -> pa.RecordBatch:
    (u, v, times), m = pairs, len(postings["key"])
    none = np.r_[np.ones(len(u), bool), np.zeros(m, bool)]
    gap, zero = np.zeros(m, np.int64), np.zeros(len(u), np.int64)
    columns = [
        pa.array(np.r_[u, postings["id"]]), pa.array(np.r_[v, gap], mask=~none), pa.array(np.r_[times, gap].astype(np.int32), mask=~none),
        pa.array(np.r_[zero, postings["key"].view(np.int64)], mask=none), *(pa.array(np.r_[zero, postings[c]].astype(np.int32), mask=none) for c in ("n", "pos")),
    ]
    return pa.RecordBatch.from_arrays(columns, ["u", "v", "times", "key", "n", "pos"])


def met(docs: DataFrame, sent_reps: Broadcast, sent: Broadcast, s: float) -> DataFrame:
    """sent_reps: a bit table, or None; sent: the rarity table. id, text of the classes' least documents (with a bit table, of those whose id it may hold) -> rows of MET: the postings of keys that several have,
    and for each class its viable pairs with the least class of a key."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = partitions * BUCKETS_PER_PARTITION

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, reps = sent.value.array(), sent_reps.value
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            p = {c: np.concatenate([h[c] for h in held]) for c, _ in POSTING}
            held.clear()
            bucket = (mix(p["key"]) % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            blobs = [pa.compress(b"".join(p[c][order[cuts[b] : cuts[b + 1]]].astype(t).tobytes() for c, t in POSTING), "zstd", asbytes=True) for b in some]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.diff(cuts)[some].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "n", "rows"])

        for b in batches:
            if reps is not None:
                b = b.filter(pa.array(in_bits(reps, b.column(0).to_numpy())))
            ids = b.column(0).to_numpy()
            for row, data, offsets in lowered(b.column(1), AT_ONCE):
                x = Sets(data, offsets)
                df = table[(x.shingle % U(RARITY_SLOTS)).astype(np.int64)]
                order = np.argsort((x.doc.astype(U) << U(32)) | df.astype(U), kind="stable")  # rarest first, then by the hash
                shingle, df = x.shingle[order], df[order]
                pos = np.arange(len(shingle)) - x.at[x.doc]
                prefix = x.n - np.ceil(s * x.n - 1e-6).astype(np.int64) + 1
                use = (pos < prefix[x.doc]) & (df > 1)  # a slot counted once is of a shingle that no other document has
                d = x.doc[use]
                held.append({"key": shingle[use], "id": ids[row + d], "n": x.n[d], "pos": pos[use]})
                size += len(d)
                if size >= HELD_POSTINGS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        now = None

        def flush() -> pa.RecordBatch:
            x = {c: np.concatenate([h[c] for h in held]) for c, _ in POSTING}
            held.clear()
            order = np.lexsort((x["id"], x["key"]))
            x = {c: v[order] for c, v in x.items()}
            key = x["key"]
            same = key[1:] == key[:-1]
            shared = np.r_[False, same] | np.r_[same, False] if len(key) else np.zeros(0, bool)
            x = {c: v[shared] for c, v in x.items()}
            key, n, pos = x["key"], x["n"].astype(np.int64), x["pos"].astype(np.int64)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            lead = np.repeat(first, np.diff(np.r_[first, len(key)]))
            i = np.flatnonzero((np.arange(len(key)) > lead) & viable(n, pos, n[lead], pos[lead], s))
            return met_rows(counted_pairs([(x["id"][i], x["id"][lead[i]])]), x)

        for b in batches:  # sorted by bucket
            for bucket, n, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if held and bucket != now:
                    yield flush()
                now = bucket
                raw, at, x = pa.decompress(rows.as_py(), n * 24, "zstd", asbytes=True), 0, {}
                for c, t in POSTING:
                    width = n * np.dtype(t).itemsize
                    x[c], at = np.frombuffer(raw[at : at + width], t), at + width
                held.append(x)
        if held:
            yield flush()

    blocks = docs.mapInArrow(send, "bucket int, n int, rows binary").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return blocks.mapInArrow(meet, MET)


def further_pairs(key: np.ndarray, u: np.ndarray, comp: np.ndarray, n: np.ndarray, pos: np.ndarray, low: int, high: int, s: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Postings in order of key and length: viable pairs under a key, of different components, that are more than low and at most high places apart."""
    out = []
    for back in range(low + 1, min(high + 1, len(key))):
        i = back + np.flatnonzero((key[back:] == key[:-back]) & (comp[back:] != comp[:-back]))
        j = i - back
        ok = viable(n[i], pos[i], n[j], pos[j], s)
        out.append((u[i[ok]], u[j[ok]]))
    return out


def next_round(postings: DataFrame, labels: DataFrame, low: int, high: int, s: float) -> DataFrame:
    """postings: u, key, n, pos -> rows of MET: pairs that are not joined yet, and the postings of keys that are still of several components."""
    partitions = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            held.clear()
            key, u, comp, n, pos = (t[c].to_numpy() for c in ("key", "u", "comp", "n", "pos"))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            mixed = np.add.reduceat(comp != np.repeat(comp[cuts[:-1]], np.diff(cuts)), cuts[:-1]) > 0
            size = np.diff(cuts)
            live = np.repeat(mixed, size)
            pairs = further_pairs(*(x[live] for x in (key, u, comp, n, pos)), low, high, s)
            keep = np.repeat(mixed & (size - 1 > high), size)
            return met_rows(counted_pairs(pairs), {"id": u[keep], "key": key[keep], "n": n[keep], "pos": pos[keep]})

        rows = 0
        for b in batches:  # sorted by key: a group may go on in the next batch
            if not b.num_rows:
                continue
            k = b.column(0).to_numpy()
            cut = int(np.searchsorted(k, k[-1]))
            if rows + cut > 100_000 and held and (cut or held[-1].column(0)[-1].as_py() != k[0]):
                held.append(b.slice(0, cut))
                yield out()
                rows, b = 0, b.slice(cut)
            held.append(b)
            rows += b.num_rows
        if held:
            yield out()

    rows = postings.join(labels, F.col("u") == F.col("node"), "left").select("key", "u", F.coalesce("label", "u").alias("comp"), "n", "pos")
    return rows.repartition(partitions, "key").sortWithinPartitions("key", "n", "u").mapInArrow(run, MET)


def shingle_sets(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """docs: id, text -> id, set (32 bits of each five-word shingle's hash, of the whole sequence where that is shorter) for the ids that the bit table may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            ids = b.column(0).to_numpy()
            keep = np.flatnonzero(in_bits(bits, ids))
            if not len(keep):
                continue
            ids, texts = ids[keep], b.column(1).take(pa.array(keep))
            for row, data, offsets in lowered(texts, AT_ONCE):
                x = Sets(data, offsets)
                short = (x.shingle >> U(32)).astype("<u4")  # ascending, as the shingles are
                yield pa.RecordBatch.from_arrays([pa.array(ids[row : row + len(x.n)]), pa.array([short[x.at[i] : x.at[i + 1]].tobytes() for i in range(len(x.n))], pa.binary())], ["id", "set"])

    return docs.mapInArrow(run, "id long, set binary")


def groups(docs: DataFrame, similarity: float = 0.8, max_distance: int = 2) -> DataFrame:
    """docs: id (long, set, unique), text -> node, label: each grouped document and the least id of its group. Others are left out.

    max_distance: bits in which fingerprints may differ to be candidates; it speeds the join up and has no effect on its result. Null and empty texts
    are equal texts, and so one group.
    """
    counted = materialize(class_table(docs))
    classes = counted.filter("part IS NULL").select("id", "cls", "cls2", "n", "fp")
    reps = materialize(classes.groupBy("cls", "cls2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("fp").alias("fp")))
    exact = classes.join(reps.filter("copies > 1").select("cls", "cls2", "rep"), ["cls", "cls2"]).filter("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))

    prints = reps.filter("n > 0").select("rep", "fp")
    least = materialize(prints.groupBy("fp").agg(F.min("rep").alias("rep")))
    ring = pigeonring_links(least, max_distance).unionByName(prints.join(least.withColumnRenamed("rep", "v"), "fp").filter("rep <> v").select(F.col("rep").alias("u"), "v"))

    few = reps.count() <= SENT_CLASSES
    alone = docs if few else docs.join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
    with sent(docs, bit_table(reps.select("rep")) if few else None) as picked, sent(docs, Packed(rarity(counted.filter("part IS NOT NULL")))) as seen:
        found = materialize(met(alone, picked, seen, similarity))
    postings = found.filter("key IS NOT NULL").select("u", "key", "n", "pos")
    ring = materialize(ring)
    wanted = materialize(postings.select(F.col("u").alias("id")).unionByName(ring.select(F.explode(F.array("u", "v")).alias("id"))).distinct())
    with sent(docs, bit_table(wanted)) as picked:
        sets = materialize(shingle_sets(docs, picked))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), "<u4") for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and both >= similarity * (len(x) + len(y) - both) - 1e-6)
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    def linked(pairs: DataFrame) -> DataFrame:
        ends = materialize(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
        some = sets.join(F.broadcast(ends) if ends.count() <= SENT_ENDS else ends, "id", "left_semi")
        side = lambda k: some.select(F.col("id").alias(k), F.col("set").alias(f"set_{k}"))
        return materialize(pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "set_u", "set_v").mapInArrow(judge, "u long, v long"))

    def most_shared(pairs: DataFrame) -> DataFrame:
        """Of each class's pairs the one under most keys."""
        summed = pairs.groupBy("u", "v").agg(F.sum("times").alias("times"))
        return summed.groupBy("u").agg(F.max_by("v", F.struct("times", -F.col("v"))).alias("v"))

    leads = found.filter("key IS NULL").select("u", "v", "times").unionByName(ring.select("u", "v", F.lit(1 << 20).alias("times")))
    links, low, high = [linked(materialize(most_shared(leads)))], 0, FIRST_REACH
    while True:
        labels = materialize(components(reduce(DataFrame.unionByName, links)))
        found = materialize(next_round(postings, labels, low, high, similarity))
        pairs = found.filter("key IS NULL").select("u", "v", "times")
        n_pairs = pairs.count()
        if n_pairs > FEW_PAIRS:
            best = materialize(most_shared(pairs))
            links.append(linked(best))
            # the others only where the best ones have not joined the two
            labels = components(links[-1].unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))
            of = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"of_{k}"))
            rest = pairs.join(best, ["u", "v"], "left_anti").join(of("u"), "u", "left").join(of("v"), "v", "left")
            pairs = rest.filter(F.coalesce("of_u", "u") != F.coalesce("of_v", "v"))
        if n_pairs:
            links.append(linked(materialize(pairs.select("u", "v").distinct())))
        postings, low, high = found.filter("key IS NOT NULL").select("u", "key", "n", "pos"), high, high * MORE
        if postings.isEmpty():
            return components(reduce(DataFrame.unionByName, links, exact))
