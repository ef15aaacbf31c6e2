"""Personal data: fixed patterns, and spans that a character-level bidirectional LSTM with a CRF adds.

The network is trained in numpy on windows of a bounded sample of the documents. Their labels are the patterns' spans, half of them rewritten to
forms that the patterns miss (a phone number without its plus, a card number in other groups, an address with spaces around its @). Texts are read in
overlapping windows; each character's scores are averaged over its windows, with more weight to a window's middle, and the CRF decodes
every stretch of windows as a whole. A decoded span counts if it holds what its kind must hold and meets no span of the patterns.

Every kind must hold a digit or an @, so windows without either cannot give a span and are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# fixed values: the kinds in order, and their patterns
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # from inside a run of digits nothing matches that does not match from its start
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TRIGGER = re.compile(r"[0-9@]")

WINDOW, STRIDE = 96, 48
EMBED, HIDDEN = 12, 16
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
#: Windows whose scores a task holds, and characters of the texts it tags together (one longer text is tagged alone).
WINDOWS_AT_ONCE = 2048
CHARS_AT_ONCE = 1 << 20
#: Characters: ASCII each by itself, other letters, other digits, anything else.
CLASSES = 131

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def valid(kind: str, s: str) -> bool:
    d = digits_of(s)
    if kind == "email":
        return "@" in s and "." in s.partition("@")[2]
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in parts)
    return 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind and start, leftmost and not overlapping within a kind; what fails its test is dropped without a second try."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    if not re.search("[0-9]", text):
        return out
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return out


def joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def char_codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.minimum(c, 130).astype(np.int16)
    odd = np.flatnonzero(c > 127)
    if len(odd):
        values, where = np.unique(c[odd], return_inverse=True)
        out[odd] = np.array([128 if chr(v).isalpha() else 129 if chr(v).isdigit() else 130 for v in values.tolist()], np.int16)[where]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tagger:
    """embed; for each direction the LSTM's input, recurrent and bias weights; emission weights; the CRF's transitions, start and end scores."""

    w: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        w = {"embed": rng.normal(0, 0.5, (CLASSES, EMBED)), "out": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), "out_b": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS), "last": np.zeros(TAGS)}
        for d in "fb":
            w |= {f"x{d}": rng.normal(0, EMBED**-0.5, (EMBED, 4 * HIDDEN)), f"h{d}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"c{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        return Tagger({k: v.astype(np.float32) for k, v in w.items()})

    def lstm(self, x: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """x: (windows, WINDOW) of character classes, read from the end in direction b -> hidden states in x's order."""
        w, n = self.w, len(x)
        ahead = w["embed"] @ w[f"x{d}"] + w[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, saved = np.empty((n, x.shape[1], HIDDEN), np.float32), []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            z = ahead[x[:, t]] + h @ w[f"h{d}"]
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                saved.append((t, h, before, i, f, o, g, tc))
            h = o * tc
            out[:, t] = h
        return out, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.lstm(x, "f")[0], self.lstm(x, "b")[0]], axis=2) @ self.w["out"] + self.w["out_b"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the CRF's negative log-likelihood, a mean over windows."""
        w, n, length = self.w, len(x), x.shape[1]
        hs, saved = zip(*(self.lstm(x, d, keep=True) for d in "fb"), strict=True)
        hidden = np.concatenate(hs, axis=2)
        e = hidden @ w["out"] + w["out_b"]
        peak = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[:, 0] = w["first"] + e[:, 0]
        for t in range(1, length):
            alpha[:, t] = peak(alpha[:, t - 1][:, :, None] + w["trans"], 1) + e[:, t]
        beta[:, -1] = w["last"]
        for t in range(length - 2, -1, -1):
            beta[:, t] = peak(w["trans"] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = peak(alpha[:, -1] + w["last"], 1)
        de = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(np.minimum(0, alpha[:, :-1, :, None] + w["trans"] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])).sum(axis=(0, 1))
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        one = np.eye(TAGS, dtype=np.float32)[y]
        de -= one
        g = {"trans": pair, "first": de[:, 0].sum(axis=0), "last": (np.exp(alpha[:, -1] + w["last"] - z[:, None]) - one[:, -1]).sum(axis=0)}
        g["out"] = np.einsum("nth,ntk->hk", hidden, de)
        g["out_b"] = de.sum(axis=(0, 1))
        dh_all = de @ w["out"].T
        g["embed"] = np.zeros_like(w["embed"])
        for k, d in enumerate("fb"):
            g[f"x{d}"], g[f"h{d}"], g[f"c{d}"] = np.zeros_like(w[f"x{d}"]), np.zeros_like(w[f"h{d}"]), np.zeros_like(w[f"c{d}"])
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, h, before, i, f, o, c_in, tc in reversed(saved[k]):
                dh = dh + dh_all[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * c_in * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c_in * c_in)], axis=1)
                g[f"x{d}"] += w["embed"][x[:, t]].T @ dz
                g[f"h{d}"] += h.T @ dz
                g[f"c{d}"] += dz.sum(axis=0)
                np.add.at(g["embed"], x[:, t], dz @ w[f"x{d}"].T)
                dh, dc = dz @ w[f"h{d}"].T, dc * f
        return {k: v / n for k, v in g.items()}

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tags of one stretch of emissions."""
        w, score, back = self.w, self.w["first"] + e[0], np.empty((len(e), TAGS), np.int8)
        for t in range(1, len(e)):
            s = score[:, None] + w["trans"]
            back[t] = s.argmax(axis=0)
            score = s[back[t], np.arange(TAGS)] + e[t]
        tags = np.empty(len(e), np.int8)
        tags[-1] = int((score + w["last"]).argmax())
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


def rewritten(kind: str, s: str, rng: np.random.Generator) -> str:
    """Another way to write a span, which the patterns miss."""
    d = digits_of(s)
    if kind == "email":
        return s.replace("@", " @ ")
    if kind == "ip":
        return s.replace(".", " . ")
    if kind == "card":
        sep = str(rng.choice([".", "/", "  "]))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    d = d[-10:]
    return str(rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"1 ({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"]))


def train(texts: list[str], steps: int = 700, batch: int = 64, rate: float = 0.01, seed: int = 4) -> Tagger | None:
    """texts: cuts of documents. None if the patterns find nothing in them."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text in texts:
        spans = sorted(base_spans(text), key=lambda s: s[1])
        spans = [s for i, s in enumerate(spans) if not i or s[1] >= spans[i - 1][2]]
        body, tags, at = [], [], 0
        for kind, s, e in spans:
            x = text[s:e] if rng.random() < 0.5 else rewritten(kind, text[s:e], rng)
            k = 1 + 2 * KINDS.index(kind)
            body += [text[at:s], x]
            tags += [0] * (s - at) + [k] + [k + 1] * (len(x) - 1)
            at = e
        body.append(text[at:])
        tags += [0] * (len(text) - at)
        x, y = char_codes("".join(body)), np.array(tags, np.int64)
        shift = int(rng.integers(0, STRIDE))
        for i in range(-shift, max(1, len(x)), STRIDE):
            lo, hi = max(0, i), min(len(x), i + WINDOW)
            if hi - lo > 8 and np.isin(x[lo:hi], [*range(48, 58), 64]).any():
                xs.append(np.pad(x[lo:hi], (0, WINDOW - hi + lo), constant_values=32))
                ys.append(np.pad(y[lo:hi], (0, WINDOW - hi + lo)))
    if not any(y.any() for y in ys):
        return None
    x, y = np.stack(xs), np.stack(ys)
    net = Tagger.new()
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step = 0
    while step < steps:
        order = rng.permutation(len(x))
        for at in range(0, min(len(x), (steps - step) * batch), batch):
            i = order[at : at + batch]
            step += 1
            for k, g in net.gradients(x[i], y[i]).items():
                g = np.clip(g, -5, 5)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def training_cuts(docs: DataFrame, documents: int = 6000, cuts: int = 1200, seed: int = 21) -> list[str]:
    """A bounded sample for training: of about `documents` documents chosen by a hash, at most `cuts` different pieces of text around digits and @.

    The hash is of (doc_id, text): rows without an id are drawn like others.
    """
    n = max(1, docs.count())
    some = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) < min(1.0, documents / n) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, at = [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text, at, found = text or "", 0, 0
                while (m := TRIGGER.search(text, at)) and found < 3:
                    lo = max(0, m.start() - WINDOW)
                    out.append((doc, text[lo : lo + 3 * WINDOW]))
                    at, found = lo + 3 * WINDOW, found + 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["doc_id", "cut"])

    found = some.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, cut string")
    return [r["cut"] for r in found.distinct().orderBy(F.xxhash64("doc_id", "cut"), "cut").limit(cuts).collect()]


class Finder:
    def __init__(self, net: Tagger) -> None:
        self.net = net
        self.shape = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32) + 1

    def added(self, texts: list[tuple[str, list[Span]]]) -> list[list[Span]]:
        """For texts with their patterns' spans, the network's further ones. Scores are held for WINDOWS_AT_ONCE windows, or for one longer stretch."""
        codes, starts, owner = [], [], []
        for i, (text, _) in enumerate(texts):
            x = char_codes(text)
            codes.append(x)
            hit = np.unique(np.flatnonzero(((x >= 48) & (x < 58)) | (x == 64)) // STRIDE)
            w = np.unique(np.concatenate([hit - 1, hit]))
            w = w[w >= 0] * STRIDE
            starts.append(w)
            owner.append(np.full(len(w), i))
        out: list[list[Span]] = [[] for _ in texts]
        if not any(len(w) for w in starts):
            return out
        size = np.array([len(x) for x in codes])
        base = np.cumsum(size + WINDOW) - size - WINDOW
        flat = np.concatenate([np.concatenate([x, np.full(WINDOW, 32, np.int16)]) for x in codes])
        own = np.concatenate(owner)
        at = np.concatenate(starts) + base[own]
        windows = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)
        # stretches of windows that touch, each decoded as a whole
        cut = np.flatnonzero(np.r_[True, np.diff(at) > STRIDE, True])
        first, last = cut[:-1], cut[1:]
        held, e = (0, 0), np.zeros((0, WINDOW, TAGS), np.float32)
        for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
            i, s = int(own[lo]), int(at[lo] - base[own[lo]])
            n = int(at[hi - 1] - at[lo]) + WINDOW
            total, weight = np.zeros((n, TAGS), np.float32), np.zeros(n, np.float32)
            for k in range(lo, hi):
                if k >= held[1]:
                    held = k, min(k + WINDOWS_AT_ONCE, len(at))
                    e = self.net.emissions(windows[at[held[0] : held[1]]])
                o = int(at[k] - at[lo])
                total[o : o + WINDOW] += e[k - held[0]] * self.shape[:, None]
                weight[o : o + WINDOW] += self.shape
            stop = min(n, int(size[i]) - s)
            text, spans = texts[i]
            for kind, b, f in spans_of(self.net.decode((total / weight[:, None])[:stop])):
                b, f = b + s, f + s
                if valid(kind, text[b:f]) and not any(x < f and b < y for _, x, y in spans):
                    out[i].append((kind, b, f))
        return out


def spans_of(tags: np.ndarray) -> Iterator[Span]:
    start = None
    for i, t in enumerate([*tags.tolist(), 0]):
        if start is not None and t != tags[start] + 1:
            yield KINDS[(int(tags[start]) - 1) // 2], start, i
            start = None
        if t % 2:
            start = i


def find_pii(docs: DataFrame, net: Tagger | None) -> DataFrame:
    """doc_id, text -> doc_id, n_email, n_ip, n_card, n_phone (the patterns' spans), base_spans, spans (kind:start:end, all), n_added.

    A null text is an empty one; rows that repeat give a row each; without a network (no sample had a span) only the patterns' spans are found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(net) if net else None
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            hot = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
            base: list[list[Span]] = [[] for _ in texts]
            more: list[list[Span]] = [[] for _ in texts]
            for i in hot:
                base[i] = base_spans(texts[i])
            some: list[int] = []
            size = 0
            for i in hot if finder else ():
                some.append(i)
                size += len(texts[i])
                if size >= CHARS_AT_ONCE or i == hot[-1]:
                    for j, found in zip(some, finder.added([(texts[j], base[j]) for j in some]), strict=True):
                        more[j] = found
                    some, size = [], 0
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([joined(x) for x in base]), pa.array([joined(x + y) for x, y in zip(base, more, strict=True)]), pa.array([len(y) for y in more], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_added long")


def redact(text: str, spans: str) -> str:
    """text with each span of find_pii replaced by its kind in brackets; of spans that overlap, the first is."""
    out, at = [], 0
    for s, e, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
            at = e
    return "".join([*out, text[at:]])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = find_pii(docs, train(training_cuts(docs)))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")
