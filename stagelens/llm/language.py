"""Language identification by a byte convolutional network.

Bytes are embedded; filters of several widths run over a window of fixed length; each filter's maximum over the window goes to a
softmax over the languages. The network is trained in numpy on a bounded sample of labelled windows. A text is cut into windows that
overlap by the widest filter less one, so that every run of bytes is seen; its languages' probabilities are the windows' means,
weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import table, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
STRIDE = WINDOW - max(WIDTHS) + 1


@dataclass
class ByteNet:
    languages: list[str]
    embed: np.ndarray  # (256, EMBED)
    filters: list[np.ndarray]  # for each width: (width * EMBED, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray  # (filters of all widths, languages)
    out_bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def padded(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(t[:WINDOW].ljust(WINDOW, b"\0") for t in texts), np.uint8).reshape(-1, WINDOW)


def train(texts: list[bytes], labels: list[str], steps: int = 1500, batch: int = 64, rate: float = 3e-3, seed: int = 5) -> ByteNet | None:
    """Adam on the cross-entropy; None without labels. Texts are cut to the window."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    x, y = padded(texts), np.searchsorted(languages, labels)
    shape = [(w * EMBED, FILTERS) for w in WIDTHS]
    net = ByteNet(languages, rng.normal(0, 0.5, (256, EMBED)), [rng.normal(0, (2 / s[0]) ** 0.5, s) for s in shape], [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages)))
    ws = net.weights()
    first, second, step = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws], 0
    while step < steps:
        order = rng.permutation(len(x))
        for at in range(0, min(len(x), (steps - step) * batch), batch):
            i = order[at : at + batch]
            xb, n = x[i], len(i)
            e = net.embed[xb].astype(np.float32)
            pooled, where = [], []
            for w, f, b in zip(WIDTHS, net.filters, net.bias, strict=True):
                cols = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
                z = cols @ f.astype(np.float32)
                k = z.argmax(axis=1)
                where.append(k)
                pooled.append(np.take_along_axis(z, k[:, None], axis=1)[:, 0] + b)
            h = np.maximum(np.concatenate(pooled, axis=1), 0)
            p = softmax(h @ net.out + net.out_bias)
            p[np.arange(n), y[i]] -= 1
            p /= n
            dh = (p @ net.out.T) * (h > 0)
            d_embed, d_filters, d_bias = np.zeros_like(net.embed), [], []
            for g, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                d = dh[:, g * FILTERS : (g + 1) * FILTERS]
                spot = where[g][:, :, None] + np.arange(w)  # (n, FILTERS, w)
                seen = xb[np.arange(n)[:, None, None], spot]
                cols = net.embed[seen].reshape(n, FILTERS, w * EMBED)
                d_filters.append(np.einsum("nfc,nf->cf", cols, d))
                d_bias.append(d.sum(axis=0))
                np.add.at(d_embed, seen, d[:, :, None, None] * f.T.reshape(FILTERS, w, EMBED)[None])
            step += 1
            for w, g, m, v in zip(ws, [d_embed, *d_filters, *d_bias, h.T @ p, p.sum(axis=0)], first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class Scorer:
    """The trained network with its first two layers folded: for each width, what a pair of bytes or a byte adds to each filter."""

    def __init__(self, net: ByteNet) -> None:
        parts = [[net.embed @ f[j * EMBED : (j + 1) * EMBED] for j in range(w)] for w, f in zip(WIDTHS, net.filters, strict=True)]
        pair = lambda a, b: np.ascontiguousarray((a[:, None] + b[None]).reshape(65536, FILTERS), dtype=np.float32)
        self.net = net
        self.two, self.three, self.four, self.four_b = pair(*parts[0]), pair(*parts[1][:2]), pair(*parts[2][:2]), pair(*parts[2][2:])
        self.three_b = parts[1][2].astype(np.float32)

    def __call__(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for (n, WINDOW) bytes."""
        bias = np.concatenate(self.net.bias)
        out = []
        for at in range(0, len(windows), 64):
            x = windows[at : at + 64]
            twos = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
            h2 = self.two.take(twos, axis=0).max(axis=1)
            z = self.three.take(twos[:, :-1], axis=0)
            z += self.three_b.take(x[:, 2:], axis=0)
            h3 = z.max(axis=1)
            z = self.four.take(twos[:, :-2], axis=0)
            z += self.four_b.take(twos[:, 2:], axis=0)
            h = np.maximum(np.concatenate([h2, h3, z.max(axis=1)], axis=1) + bias, 0)
            out.append(softmax(h @ self.net.out + self.net.out_bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.net.languages)))


def labelled_windows(docs: DataFrame, per_language: int = 600, seed: int = 11) -> tuple[list[bytes], list[str]]:
    """A bounded sample for training: about per_language different documents of each lang, chosen by a hash, two windows of each and a short cut of one.

    Documents are told apart by (doc_id, text), so that rows without an id, or of one id, are drawn like others and copies count once; the cut at twice as many a
    lang is in order of the hash. Partitions and order of the rows change nothing.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("__h", F.xxhash64("doc_id", "text", F.lit(seed)))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("__h").alias("n")).collect()}
    if not counts:
        return [], []
    of = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_language / n))])
    sampled = known.filter(F.pmod("__h", F.lit(1 << 30)) < F.element_at(of, F.col("lang")) * (1 << 30)).select("lang", "__h", "text").dropDuplicates(["lang", "__h"])
    at = lambda k: F.pmod(F.xxhash64("__h", F.lit(k)), F.greatest(F.lit(1), F.length("text") - WINDOW)) + 1
    cut = lambda k, n: F.substring("text", at(k).cast("int"), n)
    short = cut(2, (F.pmod(F.xxhash64("__h", F.lit(3)), F.lit(60)) + 8).cast("int"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("__h")) <= 2 * per_language
    rows = sampled.select("lang", "__h", F.array(cut(1, F.lit(WINDOW)), cut(2, F.lit(WINDOW)), short).alias("t")).withColumn("__first", first).filter("__first").select("lang", F.explode("t").alias("t")).collect()
    rows = sorted((r["lang"], r["t"].encode("utf-8")) for r in rows if any(c.isalpha() for c in r["t"]))
    return [t for _, t in rows], [k for k, _ in rows]


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """Adds lang_pred and score. A null text, or one without a letter, is `und` with score 0, as is any without a network; other columns stay."""
    docs = docs.drop("lang_pred", "score")
    kept = docs.columns
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(net)
        names = np.array(net.languages, dtype=object)
        for b in batches:
            n = b.num_rows
            data, at = utf8(b.column(kept.index("text")))
            sizes = np.diff(at)
            count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
            doc = np.repeat(np.arange(n), count)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = at[doc] + k * STRIDE
            length = np.minimum(WINDOW, at[doc + 1] - start)
            data = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
            total = np.zeros((n, len(names)))
            for i in range(0, len(doc), 4096):
                s, m, d = start[i : i + 4096], length[i : i + 4096], doc[i : i + 4096]
                w = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[s]
                w[np.arange(WINDOW) >= m[:, None]] = 0
                p = score(w) * m[:, None]
                edges = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                total[d[edges]] += np.add.reduceat(p, edges, axis=0)
            p = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
            letters = b.column(len(kept)).to_numpy(zero_copy_only=False).astype(bool)
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(np.where(letters, names[best], "und"), pa.string()), pa.array(np.where(letters, np.minimum(1.0, p.max(axis=1)), 0.0))], [*kept, "lang_pred", "score"])

    if net is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    return docs.withColumn("__letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(*labelled_windows(docs.filter(~held_out())))
    out = predict(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
