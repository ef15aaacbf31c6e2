"""The methods of stagelens.llm one by one: orders, draws, decoding, bounds and choices of plan, against plain versions."""

import itertools
import math
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stagelens.llm import common, components, decontaminate, language, line_dedup, mixing, pii, search, sharding, similar, suffix_dedup, token_files
from stagelens.llm.decontaminate import text_tokens


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 1 ------------------------------------------------------------------------------------------------------------------


def test_contaminated_is_all_pairs(spark):
    """Seeds and their bound lose no pair: the same leaks as tiling every document with every item."""
    rng = random.Random(8)
    items = [words(rng, n, 400) for n in (1, 2, 3, 5, 20, 40, 60)]
    docs = []
    for i in range(60):
        parts = [words(rng, rng.randrange(1, 40), 400)]
        for item in rng.sample(items, rng.randrange(3)):
            w = item.split()
            cut = sorted(rng.sample(range(len(w) + 1), min(2, len(w))))
            pieces = [w[a:b] for a, b in itertools.pairwise([0, *cut, len(w)])]
            rng.shuffle(pieces)
            parts += [" ".join(p[: rng.randrange(len(p) + 1)] if rng.random() < 0.3 else p) for p in pieces]
        rng.shuffle(parts)
        docs.append((i, " ".join(parts)))
    docs.append((60, " ".join(docs[3][1].split() * 400)))  # a very long text
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()}
    want = {}
    for i, t in docs:
        for j, item in enumerate(items):
            p = text_tokens(item)
            n = sum(x[2] for x in decontaminate.greedy_tiles(p, text_tokens(t), min(4, len(p))))
            if n >= 0.5 * len(p):
                want[i, j] = n
    assert got == want and len({j for _, j in want}) >= 5


# 2 ------------------------------------------------------------------------------------------------------------------


def test_word_ids_caches(monkeypatch):
    """With a cache that starts anew all the time, and one text after the other, the ids are the tokenizer's."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "casa,", "x1", "...", "naïve!", "Öl", "a\tb", "end.\n", "<|x|>", "it's"]) + str(rng.randrange(50)) * (rng.random() < 0.3) for _ in range(rng.randrange(60))) for _ in range(40)] + ["", None, "  \n "]
    plain = token_files.WordIds(path)
    want = [plain.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert [x.tolist() for x in plain.encode(pa.array(texts), 200)] == want
    monkeypatch.setattr(token_files, "CACHE_WORDS", 5)
    small = token_files.WordIds(path)
    assert [x.tolist() for x in small.encode(pa.array(texts), 100)] == want
    monkeypatch.setattr(small, "encode_slice", small.one_by_one)  # the way for two words of one hash
    assert [x.tolist() for x in small.encode(pa.array(texts))] == want


# 3 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_suffixes_are_sorted(seed):
    """Groups, then bytes, equal ones in the given order, whatever splits the quicksort makes and the tries see."""
    rng = np.random.default_rng(seed)
    text = np.frombuffer(b"".join(bytes(rng.integers(97, 97 + 1 + seed % 4, 60).astype(np.uint8)) * 4 + bytes(rng.integers(0, 256, 50).astype(np.uint8)) for _ in range(5)), np.uint8)
    at = rng.permutation(np.arange(0, len(text) - 100, 2))
    group = rng.integers(0, 3, len(at))
    order, same = suffix_dedup.sorted_suffixes(text, at, group)
    key = [(int(group[i]), text[at[i] : at[i] + 100].tobytes()) for i in range(len(at))]
    assert order.tolist() == sorted(range(len(at)), key=lambda i: key[i])
    assert same.tolist() == [False] + [key[a] == key[b] for a, b in itertools.pairwise(order.tolist())]


# 4 ------------------------------------------------------------------------------------------------------------------


def test_digits_without_end():
    """A number too long for an integer is no address, and stops nothing."""
    assert pii.base_spans("1.2.3." + "9" * 5000) == [] and pii.base_spans("0001.2.3.0255") == [("ip", 0, 13)]


def test_decode_is_the_best_path():
    net = pii.Tagger.new(5)
    rng = np.random.default_rng(1)
    for k in ("trans", "first", "last"):
        net.w[k] = rng.normal(0, 1, net.w[k].shape).astype(np.float32)
    e = rng.normal(0, 1, (4, pii.TAGS))
    score = lambda t: net.w["first"][t[0]] + net.w["last"][t[-1]] + sum(e[i, x] for i, x in enumerate(t)) + sum(net.w["trans"][a, b] for a, b in itertools.pairwise(t))
    best = max(itertools.product(range(pii.TAGS), repeat=4), key=score)
    assert tuple(net.decode(e).tolist()) == best


def test_windows_in_parts(monkeypatch):
    """A stretch longer than the windows held at once is decoded as if they all were."""
    rng = random.Random(4)
    net = pii.Tagger.new(7)
    texts = [("x1 " * 400 + f"call {rng.randrange(10**9)} or a@b.cd " * 20, []), ("none", []), ("5" * 700, [])]
    want = pii.Finder(net).added(texts)
    monkeypatch.setattr(pii, "WINDOWS_AT_ONCE", 3)
    assert pii.Finder(net).added(texts) == want


# 5 ------------------------------------------------------------------------------------------------------------------


def test_lines_of_rows_that_share_an_id(spark):
    """Rows of one id, and of none, keep or lose their own lines; columns that look like the operator's own stay."""
    line = "one two three four five six seven"
    rows = [(1, f"{line}\nalpha beta gamma", "a"), (1, f"delta epsilon zeta\n{line}", "b"), (None, f"{line}\neta theta iota", "c"), (None, "kappa lambda mu", "d"), (2, None, "e"), (3, "", "f")]
    out = line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string, removed string")).collect()
    got = {r["removed"]: r["text"] for r in out}
    assert got["c"] == f"{line}\neta theta iota" and got["a"] == "alpha beta gamma" and got["b"] == "delta epsilon zeta"  # the first in order keeps the line
    assert got["d"] == "kappa lambda mu" and got["e"] is None and got["f"] == ""


def test_line_rounds(spark):
    """Lines whose first candidates fail go through further rounds on the postings that the round before left."""
    rng = random.Random(21)
    texts = []
    for i in range(120):
        base = [f"k{i % 4}", *(f"x{rng.randrange(30)}" for _ in range(12))]
        texts.append(" ".join(base))
        if i % 5 == 0:
            texts.append(" ".join([*base[:-1], f"z{i}"]))
    sets = [frozenset(t.split()) for t in texts]
    want = sum(any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(i)) for i in range(len(sets)))
    got = line_dedup.line_removals(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)).agg(F.sum("n_removed")).first()[0]
    assert got == want > 20


# 6, 7 ---------------------------------------------------------------------------------------------------------------


def test_large_draws_have_the_law(monkeypatch):
    """Above numpy's limit the draw is the same law: held against it where both can draw."""
    monkeypatch.setattr(sharding, "EXACT_BELOW", 1)
    good, bad, n = 40, 70, 33
    x = np.array([sharding.hypergeometric(np.random.default_rng(s), good, bad, n) for s in range(4000)])
    mean, var = n * good / (good + bad), n * (good / (good + bad)) * (bad / (good + bad)) * ((good + bad - n) / (good + bad - 1))
    assert abs(x.mean() - mean) < 4 * (var / 4000) ** 0.5 and 0.9 < x.var() / var < 1.1
    share = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(34)}
    seen = Counter(x.tolist())
    assert sum((seen[k] - 4000 * p) ** 2 / (4000 * p) for k, p in share.items() if p > 0.005) < 40
    assert [sharding.hypergeometric(np.random.default_rng(1), g, b, n) for g, b, n in ((5, 0, 3), (0, 5, 3), (4, 4, 8), (4, 4, 0))] == [3, 0, 4, 0]


def test_large_draw():
    x = np.array([sharding.hypergeometric(np.random.default_rng(s), 3 * 10**9, 5 * 10**9, 10**6) for s in range(60)])
    sd = (10**6 * (3 / 8) * (5 / 8)) ** 0.5
    assert abs(x.mean() - 375_000) < 4 * sd / 60**0.5 and 0.5 < x.std() / sd < 1.6


def test_mix_of_repeated_ids_reruns_alike(spark):
    rng = random.Random(2)
    rows = [(i % 3, words(rng, 30), f"s{i % 2}", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    one, two = (Counter(map(tuple, mixing.mixed_documents(d).collect())) for d in (docs, docs.orderBy(F.desc("text")).repartition(5)))
    assert one == two and one


# 8 ------------------------------------------------------------------------------------------------------------------


def test_components_both_ways(spark, monkeypatch):
    rng = random.Random(12)
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, 7)], "u long, v long")
    few = {tuple(r) for r in components.components(edges).collect()}
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    assert {tuple(r) for r in components.components(edges).collect()} == few


def test_groups_whatever_the_plan(spark, monkeypatch):
    """The same groups in one task or several, with pairs sent or joined, judged at once or the best first."""
    rng = random.Random(31)
    rows = []
    for g in range(30):
        w = words(rng, 80, 3000).split()
        for k in range(6):
            v = list(w)
            for i in rng.sample(range(80), rng.randrange(3)):
                v[i] = f"other{rng.randrange(999)}"
            rows.append((100 * g + k, " ".join(v).upper() if k == 5 else " ".join(v)))
    docs = spark.createDataFrame(rows, "id long, text string")
    want = {tuple(r) for r in similar.groups(docs.repartition(1)).collect()}
    for name, value in (("SENT_CLASSES", 0), ("SENT_ENDS", 0), ("FEW_PAIRS", 0), ("FIRST_REACH", 1)):
        monkeypatch.setattr(similar, name, value)
    assert {tuple(r) for r in similar.groups(docs.repartition(7)).collect()} == want and len(want) > 100


def test_near_duplicate_stage_keeps_one_of_each_group(spark, tmp_path):
    rng = random.Random(17)
    texts = []
    for _ in range(25):
        w = words(rng, 120, 4000).split()
        texts += [" ".join(w), " ".join(w[:-4]), " ".join(w) + " tail", words(rng, 90, 4000)]
    texts += [None, "", texts[0]]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    tokens = [text_tokens(t) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in tokens]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) if sets[i] and sets[j] else (texts[i] or "") == (texts[j] or ""):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    kept = sorted(r["doc_id"] for r in corpus_pipeline.remove_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert kept == [i for i, r in enumerate(root) if r == i]


# 9 ------------------------------------------------------------------------------------------------------------------


def test_index_lets_go_of_its_postings():
    """An index takes fewer than 48 bytes a posting at its peak (57 before)."""
    rng, n = np.random.RandomState(7), 8000
    key = np.unique(np.repeat(np.arange(n), 500) * 50_000 + rng.zipf(1.3, n * 500) % 50_000)
    doc = (key // 50_000).astype(np.int32)
    length = np.bincount(doc, minlength=n).astype(np.int32)
    tracemalloc.start()
    try:
        postings = [doc.copy(), (key % 50_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.ones(len(key), np.int32)]
        tracemalloc.reset_peak()
        index = search.Index(np.arange(n), length, postings, 100.0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not postings and len(index.docs) == len(doc) and peak < 48 * len(doc), peak / len(doc)


def test_search_over_many_blocks(spark):
    """Blocks, groups of alike documents, floors and pivots: the same as scoring every pair, long queries too."""
    rng = random.Random(5)
    texts = []
    for i in range(900):
        n = 2000 if i % 300 == 0 else rng.randrange(5, 60)
        texts.append(" ".join(f"l{i % 3}x{min(rng.randrange(1, 300), rng.randrange(1, 300))}" if rng.random() < 0.9 else f"r{rng.randrange(900)}" for _ in range(n)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = docs.filter("doc_id % 60 = 0").withColumnRenamed("doc_id", "query_id")
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in search.top_k(docs, asked, 7, 500).collect()}
    counts = [Counter(text_tokens(t)) for t in texts]
    df = Counter(t for c in counts for t in c)
    mean = sum(sum(c.values()) for c in counts) / len(counts)
    for q in range(0, 900, 60):
        scores = []
        for i, c in enumerate(counts):
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            s = sum(math.log1p((900 - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + norm) for t in counts[q] if t in c)
            if i != q and s > 0:
                scores.append((-s, i))
        for k, (s, i) in enumerate(sorted(scores)[:7]):
            assert got[q, k + 1][0] == i and abs(got[q, k + 1][1] + s) < 1e-6


# folders ------------------------------------------------------------------------------------------------------------


def test_no_machine_local_folder_on_a_cluster():
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        common.scratch(fake)


def test_lines_of_rows_without_or_of_one_id(spark):
    """Equal documents of one doc_id, or of none, are documents of their own: the first keeps its lines."""
    text = "alpha beta gamma delta\nepsilon zeta eta theta"
    rows = [(None, text), (None, text), (7, "one two three four\nfive six seven"), (7, "one two three four\nfive six seven"), (8, "quite another line here")]
    got = line_dedup.line_removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(None, 2, 0, []), (None, 2, 2, [0, 1]), (7, 2, 0, []), (7, 2, 2, [0, 1]), (8, 1, 0, [])], key=str)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_language_sample_of_rows_without_id(spark, parts):
    """Rows without an id are drawn like others, whatever the partitions: 2,000 English and 700 French ones, many of them copies."""
    rows = [(None, "en", f"the house number {i % 1500} stands by the river and the road") for i in range(2000)] + [(None, "fr", f"la maison numero {i} est sur la rive du fleuve") for i in range(700)] + [(None, "de", "ein Haus am Fluss")] * 400
    got = language.labelled_windows(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(parts), per_language=300)
    texts, langs = got
    per = {k: langs.count(k) for k in ("en", "fr", "de")}
    assert 500 < per["en"] < 1300 and 500 < per["fr"] < 1300 and per["de"] == 3
    assert got == language.labelled_windows(spark.createDataFrame(rows[::-1], "doc_id long, lang string, text string").repartition(2), per_language=300)
