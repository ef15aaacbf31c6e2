"""Spelling variants: words that differ by one code point, found with a trie of frequency vectors.

A word's code points fall into GROUPS letter groups; its vector has how often each occurs. One inserted, deleted or replaced code point gives a vector with
at most one more in one group (surplus) and at most one less in another (deficit). The trie has a level for each group; a search goes down it with a budget of
one surplus and one deficit, and the words at the leaves that it reaches are verified. Its upper levels are spread over the tasks: a word has one home, the
prefix of its vector, and calls at the prefixes that the budget reaches; tasks hold tries below prefixes. Prefixes with many words are split, and called at
in all splits. All probes of a task go down a level at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: A word, as runs of Latin letters.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DROPPED = 97
GROUPS, MOST = 16, 15
#: Words that a task counts before it sends the counts on.
HELD_WORDS = 400_000
#: Words of a prefix in one split; the longest word that is verified as a row of a matrix; rows that are held, and probes that go down a trie at once.
SPLIT_WORDS, MATRIX_LENGTH, AT_ONCE, PROBES = 20_000, 40, 100_000, 5_000


def mangled_words(doc_id: int | None, text: str | None) -> Counter:
    """The runs of a text with A-Z in lower case. Where 97 divides the CRC-32 of `<doc_id>:<run>` (a null id is written as nothing), one code point of the run goes."""
    found: Counter = Counter()
    seed = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    for run, n in Counter(RUN.findall((text or "").translate(LOWER))).items():
        h = zlib.crc32(run.encode(), seed)
        if h % DROPPED == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        found[run] += n
    return found


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """docs: doc_id, text -> word, n: how often words of at least `shortest` code points occur in all texts, if at least `least` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in mangled_words(doc, text.as_py()).items():
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    each = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def vectors(words: list[str]) -> np.ndarray:
    """Rows of counts by letter group (a code point's remainder), capped; capped counts differ by no more than true ones."""
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(row * GROUPS + code % GROUPS, minlength=len(words) * GROUPS)
    return np.minimum(counts, MOST).reshape(-1, GROUPS).astype(np.int8)


def calls(levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All changes of the first levels within the budget, but of each and its opposite only one: the change, surplus spent, deficit spent."""
    out = [(np.zeros(levels, np.int8), 0, 0)]
    unit = np.eye(levels, dtype=np.int8)
    for i in range(levels):
        out.append((unit[i], 1, 0))
        out += [(unit[i] - unit[j], 1, 1) for j in range(i + 1, levels)]
    change, surplus, deficit = zip(*out, strict=True)
    return np.array(change), np.array(surplus), np.array(deficit)


def prefix_keys(counts: np.ndarray) -> np.ndarray:
    """Prefixes as numbers, four bits a level."""
    return (counts.astype(np.int64) << (4 * np.arange(counts.shape[1]))).sum(axis=1)


def one_apart(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


class Words:
    """Words as rows of a matrix of code points; long ones are kept as text only."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        width = MATRIX_LENGTH + 1
        raw = "".join(w.ljust(width, "\0") if len(w) <= MATRIX_LENGTH else "\0" * width for w in words)
        self.codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)

    def near(self, other: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (row i here, row j there) are one code point apart."""
        out = np.zeros(len(i), bool)
        n, m = self.size[i], other.size[j]
        ok = np.abs(n - m) <= 1
        for k in np.flatnonzero(ok & (np.maximum(n, m) > MATRIX_LENGTH)).tolist():
            out[k] = one_apart(self.words[i[k]], other.words[j[k]])
        ok &= np.maximum(n, m) <= MATRIX_LENGTH
        same = np.flatnonzero(ok & (n == m))
        out[same] = (self.codes[i[same]] != other.codes[j[same]]).sum(axis=1) == 1
        for which, a, b in ((ok & (n + 1 == m), self.codes[i], other.codes[j]), (ok & (n == m + 1), other.codes[j], self.codes[i])):
            k = np.flatnonzero(which)
            a, b = a[k], b[k]  # the shorter, the longer
            differ = a != b
            first = differ.argmax(axis=1)  # the longer word's last code point meets padding at the latest
            out[k] = ((a[:, :-1] == b[:, 1:]) | (np.arange(a.shape[1] - 1) < first[:, None])).all(axis=1)
        return out


class Trie:
    """A trie of rows of counts below a root for each prefix. A level is a sorted array of (node above, count)."""

    def __init__(self, roots: np.ndarray, counts: np.ndarray) -> None:
        self.order = np.lexsort([*counts.T[::-1], roots])
        self.roots, node = np.unique(roots[self.order], return_inverse=True)
        self.levels = []
        for column in counts[self.order].T:
            keys, node = np.unique(node * (MOST + 2) + column, return_inverse=True)
            self.levels.append(keys)
        nodes = int(node.max()) + 1 if len(node) else 0
        self.first = np.searchsorted(node, np.arange(nodes + 1))

    def search(self, roots: np.ndarray, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (probe, row of the trie) whose counts differ within what each probe's budget has left."""
        node = np.minimum(np.searchsorted(self.roots, roots), max(0, len(self.roots) - 1))
        probe = np.flatnonzero(self.roots[node] == roots) if len(self.roots) else np.zeros(0, np.int64)
        node, more, less = node[probe], surplus[probe], deficit[probe]
        for level, keys in enumerate(self.levels):
            count = counts[probe, level].astype(np.int64)
            steps = []
            for step, may in ((0, None), (1, more > 0), (-1, (less > 0) & (count > 0))):
                k = np.arange(len(probe)) if may is None else np.flatnonzero(may)
                key = node[k] * (MOST + 2) + count[k] + step
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                k = k[hit]
                steps.append((probe[k], at[hit], more[k] - (step > 0), less[k] - (step < 0)))
            probe, node, more, less = (np.concatenate(x) for x in zip(*steps, strict=True))
        n = self.first[node + 1] - self.first[node]
        ends = np.cumsum(n)
        rows = np.repeat(self.first[node] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return np.repeat(probe, n), self.order[rows]


NEAR = "word string, other string, other_n long"


def near_words(vocabulary: DataFrame, levels: int | None = None, split_words: int = SPLIT_WORDS) -> DataFrame:
    """vocabulary: word (distinct), n -> word, other, other_n: all pairs one code point apart, both ways.

    levels: how many levels of the trie are spread over tasks; by default one more with each fourfold number of words.
    """
    spark = vocabulary.sparkSession
    if levels is None:
        levels = int(min(10, max(3, np.log(max(1, vocabulary.count()) / 200) / np.log(4))))
    change, spent_more, spent_less = calls(levels)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 5000):
                some = batch.slice(start, 5000)
                own = vectors(some.column(0).to_pylist())[:, :levels]
                home = prefix_keys(own)
                there = own[:, None, :] + change[None, :, :]
                row, call = np.nonzero(((there >= 0) & (there <= MOST)).all(axis=2))
                yield pa.RecordBatch.from_arrays([pa.array(prefix_keys(there[row, call])), pa.array(call.astype(np.int32)), pa.array(home[row]), some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row))], ["prefix", "call", "home", "word", "n"])

    called = vocabulary.select("word", "n").mapInArrow(sent, "prefix long, call int, home long, word string, n long")
    large = called.filter("call = 0").groupBy("prefix").agg(F.count("*").alias("__c")).filter(F.col("__c") > split_words).select("prefix", F.ceil(F.col("__c") / split_words).cast("int").alias("__s"))
    split: Column = F.coalesce("__s", F.lit(1))
    own = F.when(F.col("call") == 0, F.pmod(F.xxhash64("word"), split).cast("int"))
    dealt = called.join(large, "prefix", "left").withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0), split - 1)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(block: pa.Table) -> Iterator[pa.RecordBatch]:
            """The pairs of whole roots. A pair of one prefix meets from both sides: the lesser word reports it."""
            words, n, call, root, home = (block[c].to_pylist() if c == "word" else block[c].to_numpy() for c in ("word", "n", "call", "root", "home"))
            below, at_home, probes = vectors(words)[:, levels:], np.flatnonzero(home), np.flatnonzero(call >= 0)
            trie, matrix = Trie(root[at_home], below[at_home]), Words(words)
            for start in range(0, len(probes), PROBES):
                k = probes[start : start + PROBES]
                i, j = trie.search(root[k], below[k], 1 - spent_more[call[k]], 1 - spent_less[call[k]])
                i, j = k[i], at_home[j]
                ok = np.concatenate([np.zeros(0, bool), *(matrix.near(matrix, i[a : a + AT_ONCE], j[a : a + AT_ONCE]) for a in range(0, len(i), AT_ONCE))])
                pairs = [(a, b) for a, b, c in zip(i[ok].tolist(), j[ok].tolist(), call[i[ok]].tolist(), strict=True) if c or words[a] < words[b]]
                a, b = [x for p in pairs for x in p], [x for p in pairs for x in p[::-1]]
                yield pa.RecordBatch.from_arrays([pa.array([words[x] for x in a], pa.string()), pa.array([words[x] for x in b], pa.string()), pa.array(n[b], pa.int64())], ["word", "other", "other_n"])

        block, least = None, AT_ONCE
        for batch in batches:
            block = pa.Table.from_batches([*(block.to_batches() if block else []), batch])
            if len(block) < least:
                continue
            root = block["root"].to_numpy()
            rest = int((root == root[-1]).sum())
            if rest < len(block):
                yield from found(block.slice(0, len(block) - rest))
                block, least = block.slice(len(block) - rest), max(AT_ONCE, 2 * rest)
            elif rest > 4 * AT_ONCE:  # one root alone: its homes, which stand first, stay for its further calls
                yield from found(block)
                block = block.filter(block["home"])
                block = block.set_column(block.column_names.index("call"), "call", pa.array(np.full(len(block), -1, np.int32)))
                least = len(block) + AT_ONCE
        if block:
            yield from found(block)

    root = (F.col("prefix") + F.shiftleft(F.col("part").cast("long"), 40)).alias("root")
    rows = dealt.select(root, F.coalesce(F.col("own") == F.col("part"), F.lit(False)).cast("int").alias("home"), "call", "word", "n")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n_parts, "root").sortWithinPartitions("root", F.desc("home")).mapInArrow(search, NEAR)


def with_roots(forms: DataFrame) -> DataFrame:
    """word, form (not null; forms lead to no cycle) -> word, root: the last form reached. Pointers double, so that the rounds grow with the logarithm of a chain."""
    hop = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("on")))
    while not hop.filter("on").isEmpty():
        up = hop.select(F.col("word").alias("__w"), F.col("root").alias("__r"), F.col("on").alias("__on"))
        hop = materialize(hop.join(up, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.coalesce("__on", F.lit(False)).alias("on")))
    return hop.select("word", "root")


def variant_groups(docs: DataFrame, shortest: int = 5, least: int = 3, levels: int | None = None, split_words: int = SPLIT_WORDS) -> DataFrame:
    """docs: doc_id, text -> word, form, root, n, n_near, form_n: a row for each word of at least `shortest` code points that occurs `least` times or more.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest n (of equals the first in code-point
    order) if that is at least twice the word's n; its root is the end of its chain of forms, or the word itself. Null and empty texts hold no words; a null
    doc_id is written as nothing where runs are hashed. Repeated rows count as often as they stand there; an empty table has no words. Other columns are not read.
    """
    vocabulary = materialize(word_counts(docs, shortest, least))
    near = near_words(vocabulary, levels, split_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), "other")).alias("best"))
    rows = vocabulary.join(near, "word", "left").withColumn("best", F.when(F.col("best.other_n") >= 2 * F.col("n"), F.col("best")))
    rows = materialize(rows.select("word", F.col("best.other").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.other_n").alias("form_n")))
    roots = with_roots(rows.filter("form IS NOT NULL").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(table(spark, sf_dir, "documents"))
