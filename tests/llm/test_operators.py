"""The operators of stagelens.llm on small tables: against brute force, with nulls, empty and repeated rows, ties, long texts and empty tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagelens.llm import components, decontaminate, language, line_dedup, mixing, pii, search, sharding, simhash, similar, suffix_dedup, token_files
from stagelens.llm.decontaminate import text_tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=40):
    """Texts with copies, near copies, repeated lines and passages, nulls, empty and odd ones."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(5, 120)) for _ in range(n)]
    common = words(rng, 40)
    texts += [texts[0], texts[1] + " tail", texts[2].replace("w1 ", "w2 "), common + "\n" + texts[3], texts[4] + "\n" + common, "\n".join([common, texts[5], common]), "", None, None, " \n\t ", "é" * 300, "a" * 500, "x", "Äpfel und Öl " * 20]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (None, "no id here", None, None, None), (3, "a second three", "en", None, 1), rows[7]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).withColumn("size", F.lit("clash")).withColumn("shard", F.lit("clash")).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


# 1 ------------------------------------------------------------------------------------------------------------------


def test_tiles_by_hand():
    assert decontaminate.greedy_tiles("a b c d e f".split(), "d e f x a b c".split(), 2) == [(0, 4, 3), (3, 0, 3)]
    assert decontaminate.greedy_tiles("a b".split(), "a b".split(), 3) == []
    assert decontaminate.greedy_tiles([], [], 3) == []
    assert sum(n for _, _, n in decontaminate.greedy_tiles(list("abcabc"), list("abc"), 2)) == 3


@pytest.mark.parametrize("seed", range(30))
def test_tiles_against_plain_greedy(seed):
    """Tiles never overlap, agree on both sides, and cover what the plain algorithm (always the longest match) covers."""
    rng = random.Random(seed)
    a, b = [rng.randrange(4) for _ in range(25)], [rng.randrange(4) for _ in range(60)]
    tiles = decontaminate.greedy_tiles(a, b, 3)
    used_a, used_b = Counter(), Counter()
    for i, j, n in tiles:
        assert a[i : i + n] == b[j : j + n] and n >= 3
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))
    assert max(used_a.values(), default=1) == 1 and max(used_b.values(), default=1) == 1
    free_a, free_b, lengths = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < 3:
            break
        n, i, j = best[0], -best[1], -best[2]
        lengths.append(n)
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False
    assert max([n for _, _, n in tiles], default=0) == max(lengths, default=0)
    assert [n for _, _, n in tiles] == sorted((n for _, _, n in tiles), reverse=True)


def test_contaminated(spark, docs, empty):
    rng = random.Random(5)
    item = words(rng, 30, 1000)
    w = item.split()
    extra = [(900, words(rng, 50) + " " + item + "!"), (901, " ".join(w[20:] + w[10:20] + w[:10]).upper()), (902, " ".join(w[:6]) + " " + words(rng, 40)), (903, None)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (None, item), (1, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_tiles"]) for r in decontaminate.contaminated(more, items).collect()}
    assert got == {(900, 1): (1.0, 1), (901, 1): (1.0, 3)}
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(more, items.limit(0)).count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 239, 240, 241, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 9, 5000, 1 << 50])
def test_pack_round_trip(n, top):
    x = np.random.default_rng(n).integers(0, top, n)
    words_, offsets, escapes, _ = token_files.pack(x)
    assert (token_files.unpack(words_, offsets, escapes, n) == x).all()


def test_pack_blocks_stand_alone():
    x = np.random.default_rng(3).integers(0, 6000, 5000)
    w, offsets, escapes, escape_offsets = token_files.pack(x)
    for b in range(len(offsets) - 1):
        part = x[b * token_files.BLOCK : (b + 1) * token_files.BLOCK]
        got = token_files.unpack(w[offsets[b] : offsets[b + 1]], np.array([0, offsets[b + 1] - offsets[b]]), escapes[escape_offsets[b] : escape_offsets[b + 1]], len(part))
        assert (got == part).all()


def test_token_files(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = [(800, "it's <|endoftext|> é \x1c a b ,. !?;x' 　 don't"), (801, "word," * 3000)]
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    files = token_files.write_token_files(some, token_files.scratch(spark), path, segment_ids=500)
    got = token_files.read_token_files(files).join(token_files.file_starts(files), "part").collect()
    tokenizer = Tokenizer.from_file(path)
    want = Counter((i, zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows_of(some))
    assert Counter((r["doc_id"], zlib.crc32(r["ids"])) for r in got) == want
    got.sort(key=lambda r: r["start"] + r["file_start"])
    at = 0
    for r in got:
        assert r["start"] + r["file_start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_files.read_token_files(token_files.write_token_files(empty, token_files.scratch(spark), path)).count() == 0


# 3 ------------------------------------------------------------------------------------------------------------------


def brute_spans(texts):
    """Kept bytes and runs removed of texts in order."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        out.append((bytes(c for c, g in zip(b, gone, strict=True) if not g), len(re.findall(b"\1+", bytes(gone)))))
    return out


def test_suffix_dedup(spark, docs, empty):
    rows = sorted(((i, t) for i, t in rows_of(docs) if i is not None and not (i == 3 or i == 7)), key=lambda r: r[0])
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_spans"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: x for (i, _), x in zip(rows, brute_spans(t for _, t in rows), strict=True)}
    assert suffix_dedup.remove_repeats(docs).count() == docs.count()
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_equal_rows(spark):
    """Of rows equal in doc_id (or without one) and text, the first keeps its bytes; with rows that share an id, as brute force in order of (doc_id, hash)."""
    rng = random.Random(6)
    a, b = words(rng, 60, 1000), words(rng, 90, 1000)
    rows = [(None, a)] * 4 + [(None, b + a)] + [(3, b)] * 3 + [(3, "short")] * 2 + [(3, None), (3, ""), (4, "x" * 100), (4, "x" * 100), (5, a + "tail"), (6, words(rng, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = sorted(docs.select("doc_id", "text", F.xxhash64("text")).collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want = Counter((r[0], len((r[1] or "").encode()), *x) for r, x in zip(order, brute_spans(r[1] for r in order), strict=True))
    got = suffix_dedup.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), r["n_spans"]) for r in got) == want
    assert all(r["n_removed"] == r["n_bytes"] - len(r["kept"]) for r in got)


@pytest.mark.parametrize("seed", range(8))
def test_equal_strings(seed):
    rng = np.random.default_rng(seed)
    text = np.frombuffer(b"".join(bytes(rng.integers(97, 99, 40).astype(np.uint8)) * 6 for _ in range(4)), np.uint8)
    at = np.arange(0, len(text) - 100, 3)
    same = suffix_dedup.equal_strings(text, at, np.zeros(len(at), np.int64))
    strings = [text[i : i + 100].tobytes() for i in at]
    assert {(i, j) for i in range(len(at)) for j in range(len(at)) if same[i] == same[j]} == {(i, j) for i in range(len(at)) for j in range(len(at)) if strings[i] == strings[j]}


# 4 ------------------------------------------------------------------------------------------------------------------

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


@pytest.mark.parametrize("seed", range(60))
def test_base_spans_as_the_patterns(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "B7", "@", ".", "x@y.zz", "-", " ", "+1 ", "192.168.0.1", "300.1.1.1", "4012888888881881", "12", "(555) ", "é", "..", "%"]) for _ in range(60))
    want = [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, text) if k == "email" or pii.valid(k, m[0])]
    assert pii.base_spans(text) == want


def test_tagger_gradients():
    """Of the negative log-likelihood, against differences of it, whose partition sum is taken over all tag sequences by a plain recursion."""
    net = pii.Tagger.new(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    for k in ("trans", "first", "last"):
        net.w[k] = rng.normal(0, 0.3, net.w[k].shape)
    x, y = rng.integers(0, pii.CLASSES, (2, 7)), rng.integers(0, pii.TAGS, (2, 7))

    def loss():
        total = 0.0
        for e, tags in zip(net.emissions(x), y, strict=True):
            a = net.w["first"] + e[0]
            score = net.w["first"][tags[0]] + e[0, tags[0]]
            for t in range(1, len(e)):
                a = np.log(np.exp(a[:, None] + net.w["trans"]).sum(axis=0)) + e[t]
                score += net.w["trans"][tags[t - 1], tags[t]] + e[t, tags[t]]
            total += np.log(np.exp(a + net.w["last"]).sum()) - score - net.w["last"][tags[-1]]
        return total / len(x)

    grads = net.gradients(x, y)
    for k, g in grads.items():
        spot = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        keep = net.w[k][spot]
        net.w[k][spot] = keep + 1e-3
        up = loss()
        net.w[k][spot] = keep - 1e-3
        down = loss()
        net.w[k][spot] = keep
        assert math.isclose((up - down) / 2e-3, g[spot], rel_tol=0.03, abs_tol=1e-4), k


def test_pii(spark, docs, empty):
    rng = random.Random(3)
    train = [f"{words(rng, 8)} joe{i}@mail.example.com {words(rng, 5)} 10.0.{i % 200}.7 {words(rng, 6)} +1 ({200 + i % 700}) 555-{1000 + i} {words(rng, 5)} 4012 8888 8888 1881 end" for i in range(150)]
    net = pii.train(train)
    text = "é call (743) 555-3824 or write ann@host.example.org now"
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(700, text), (701, "1" * 30_000), (702, "@" * 5000)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in pii.find_pii(some, net).collect()}
    assert got[700]["n_email"] == 1 and got[700]["base_spans"] == f"email:{text.index('ann')}:{text.index(' now')}"
    assert got[700]["base_spans"] in got[700]["spans"] and pii.redact(text, got[700]["base_spans"]) == "é call (743) 555-3824 or write [email] now"
    assert got[701]["n_card"] == 0 and got[702]["spans"] == ""
    assert pii.find_pii(empty, net).count() == 0 and pii.find_pii(docs, None).count() == docs.count() and pii.train([]) is None
    held = [pii.rewritten("phone", f"+1 ({300 + i}) 555-{2000 + i}", np.random.default_rng(i)) for i in range(60)]
    finder = pii.Finder(net)
    texts = [f"{words(rng, 7)} {h} {words(rng, 7)}" for h in held]
    found = finder.added([(t, []) for t in texts])
    assert sum(any(t[s:e] in h or h in t[s:e] for _, s, e in f) for t, h, f in zip(texts, held, found, strict=True)) >= 0.7 * len(held)


def test_long_added_span():
    """A span that the network decodes is kept whatever its length."""
    text = "write to " + "part." * 20 + "name @ " + "host-" * 8 + "a.example.org now"
    first, end = text.index("part"), text.index(" now")

    class Decoded:
        def emissions(self, x):
            return np.zeros((*x.shape, pii.TAGS), np.float32)

        def decode(self, e):
            tags = np.zeros(len(e), np.int64)
            tags[first] = 1 + 2 * pii.KINDS.index("email")
            tags[first + 1 : end] = tags[first] + 1
            return tags

    pad = " 1" * pii.WINDOW  # so that windows begin at 0
    assert pii.Finder(Decoded()).added([("1" + text[1:] + pad, [])]) == [[("email", first, end)]]


# 5 ------------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    """Removed line numbers by doc_id, of documents in order."""
    earlier, out = [], {}
    for i, t in rows:
        out[i] = []
        for no, line in enumerate((t or "").split("\n")):
            s = set(text_tokens(line))
            if s:
                if any(9 * len(s & e) >= 4 * (len(s) + len(e)) for e in earlier):
                    out[i].append(no)
                earlier.append(s)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(1, 25), 30).split() for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(0, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(40)}"
            lines.append(" ".join(w))
        rows.append((i, rng.choice(["\n".join(lines), "", None, "\n\n" + "\n".join(lines)])))
    got = {r["doc_id"]: list(r["removed"]) for r in line_dedup.line_removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_edges(spark, docs, empty):
    out = line_dedup.deduplicate_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert line_dedup.line_removals(empty).count() == 0
    many = spark.createDataFrame([(1, "\n" * 70_000 + "a b c"), (2, "a b c\n!")], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_lines"], list(r["removed"])) for r in line_dedup.line_removals(many).collect()} == {1: (70_001, []), 2: (2, [0])}


def test_large_token_group(spark):
    """Over 256 similar lines under one token: candidates are found block by block, and all but the first go."""
    rows = [(i, "same line of many words that all share but one " + f"x{i}") for i in range(1500)]
    got = line_dedup.line_removals(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_removed")).first()[0]
    assert got == 1499


# 6 ------------------------------------------------------------------------------------------------------------------


def test_shards(docs, empty):
    out = sharding.uniform_shards(docs, 4, ["doc_id", "text"], rows_per_task=7)
    got = out.select("doc_id", "text", "shard", "slot").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows_of(docs))
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.uniform_shards(empty, 4, ["doc_id"]).count() == 0


def test_matrix_margins_and_law():
    counts, targets = np.array([5, 0, 9, 14, 2]), np.array([7, 8, 7, 8])
    ends = np.concatenate([[0], np.cumsum(counts)])
    cells = []
    for seed in range(400):
        m = np.array([sharding.matrix_row(p, ends, targets, seed) for p in range(5)])
        assert (m.sum(axis=1) == counts).all() and (m.sum(axis=0) == targets).all()
        cells.append(m[2, 1])
    mean, var = 9 * 8 / 30, 9 * (8 / 30) * (22 / 30) * (21 / 29)
    assert abs(np.mean(cells) - mean) < 4 * (var / 400) ** 0.5 and 0.7 < np.var(cells) / var < 1.35


def test_take_above_the_exact_limit():
    x = sharding._take(np.random.default_rng(1), np.array([3 * 10**9, 10**9, 5]), 2 * 10**9)
    assert x.sum() == 2 * 10**9 and abs(x[0] - 1.5e9) < 1e6 and 0 <= x[2] <= 5


# 7 ------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        weight = sum(w[s] for s in names if s not in capped)
        t = {s: 2 * sizes[s] if s in capped else rest * w[s] / weight for s in names}
        over = {s for s in names if t[s] > 2 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mixing(spark, docs, empty):
    sized = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    got = mixing.taken(sized).collect()
    rows = docs.select("doc_id", "source", "text").collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], count(r["text"])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += count(r["text"])
    want = sorted((v, brute_targets(sizes)[s]) for s, v in sizes.items())
    assert sorted({(r["source_size"], r["target"]) for r in got}) == [(a, pytest.approx(b)) for a, b in want]
    for size, target in want:
        took = sum(r["taken"] for r in got if r["source_size"] == size)
        assert abs(took - target) <= max(0.05 * target, 4)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    again = Counter(map(tuple, mixing.taken(sized.repartition(5)).collect()))
    assert again == Counter(map(tuple, got))
    assert mixing.taken(empty.select("doc_id", "source", F.lit(0).cast("long").alias("size"))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permuted(spark, n):
    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()]
    assert sorted(got) == list(range(n)) and (n < 64 or got != sorted(got))


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = docs.collect()
    texts = {}
    for r in rows:
        texts.setdefault(r["doc_id"], set()).add(r["text"])
    for r in out.collect():
        assert any(r["text"] == t or set(r["text"].split()) <= set((t or "").split()) for t in texts[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])


# 8 ------------------------------------------------------------------------------------------------------------------


def brute_print(text):
    from xxhash import xxh64

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, linked):
    parent = list(range(len(items)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_near_duplicates(spark, docs, empty):
    rows = sorted({(i, t) for i, t in rows_of(docs) if i is not None and i != 3}, key=lambda r: r[0])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints, lambda x, y: (x ^ y).bit_count() <= 2)
    assert got == {i: (f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, roots, strict=True)}
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowded", [1, 3, 1000])
def test_pigeonring_is_exact(spark, crowded):
    """Both ways, pairs under keys and common midpoints, give the components of all pairs."""
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(25)})
    table = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "rep long, fp long")
    got = {r["node"]: r["label"] for r in components.components(simhash.pigeonring_links(table, crowded=crowded)).collect()}
    want = brute_components(prints, lambda x, y: (x ^ y).bit_count() <= 2)
    assert [got.get(i, i) for i in range(len(prints))] == want


def test_similar_groups(spark, empty):
    rng = random.Random(4)
    rows = []
    for g in range(40):
        w = words(rng, 200, 5000).split()
        rows.append((10 * g, " ".join(w)))
        v = list(w)
        v[rng.randrange(10, 190)] = "changed"
        rows.append((10 * g + 1, " ".join(v)))
        rows.append((10 * g + 2, " ".join(w)))
        rows.append((10 * g + 3, " ".join(x if rng.random() < 0.8 else "other" for x in w)))
    rows += [(9001, None), (9002, "")]
    got = {r["node"]: r["label"] for r in similar.groups(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert all(got[10 * g + 2] == 10 * g for g in range(40)) and sum(got.get(10 * g + 1) == 10 * g for g in range(40)) >= 38
    assert not any(10 * g + 3 in got for g in range(40)) and got[9002] == 9001
    assert similar.groups(spark.createDataFrame([], "id long, text string")).count() == 0


def shingled(text):
    w = text_tokens(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(x, y):
    return x == y if not (x and y) else 5 * len(x & y) >= 4 * len(x | y)


def assert_grouped(spark, texts):
    got = {r["node"]: r["label"] for r in similar.groups(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == brute_components([shingled(t) for t in texts], alike)


def test_similar_block_edits(spark):
    """Of pairs by bands of similarity whose tail is replaced, cut off or added to, all are found."""
    rng = random.Random(11)
    texts = []
    for g in range(120):
        w = words(rng, rng.randrange(60, 400), 5000).split()
        n = max(1, int(len(w) * (0.02, 0.05, 0.08, 0.1, 0.17, 0.3)[g % 6]))
        texts += [" ".join(w), " ".join([w[:-n] + words(rng, n, 5000).split(), w + words(rng, n, 5000).split(), w[:-n], words(rng, n, 5000).split() + w][g // 6 % 4])]
    bands = Counter(int(20 * len(a & b) / len(a | b)) for a, b in ((shingled(texts[i]), shingled(texts[i + 1])) for i in range(0, len(texts), 2)))
    assert all(bands[k] >= 8 for k in (16, 17, 18, 19))
    assert_grouped(spark, texts)


def test_similar_reformatted(spark):
    """Texts of equal words in another case, white space, punctuation, repetition or order: judged by their shingles, in one task or not."""
    rng = random.Random(12)
    texts = []
    for _ in range(12):
        t = words(rng, 80, 5000)
        w = t.split()
        texts += [t, t.upper(), t.replace(" ", ",\n"), t + " " + t, " ".join(w[40:] + w[:40]), " ".join(sorted(w))]
    assert_grouped(spark, texts)


def test_similar_crowded(spark):
    """Families under one key of which only some pairs are similar: every viable pair is judged."""
    rng = random.Random(13)
    texts = []
    for edits in (2, 4, 5, 7):
        base = words(rng, 300, 5000).split()
        for _ in range(70):
            w = list(base)
            for i in rng.sample(range(300), rng.randrange(1, 2 * edits)):
                w[i] = f"other{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    template = words(rng, 200, 5000)
    for _ in range(60):
        own = words(rng, 60, 10**6)
        texts += [own + " " + template, own.rsplit(" ", 2)[0] + " " + template] if rng.random() < 0.5 else [own + " " + template]
    assert_grouped(spark, texts)


# 9 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("per_shard", [8, 1000])
def test_search(spark, docs, empty, per_shard):
    rows = sorted({(i, t) for i, t in rows_of(docs) if i is not None and i != 3}, key=lambda r: r[0])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    asked = table.filter("doc_id % 4 = 0").withColumnRenamed("doc_id", "query_id")
    got = [(r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in search.top_k(table, asked, 5, per_shard).orderBy("query_id", "rank").collect()]
    terms = {i: Counter(text_tokens(t)) for i, t in rows}
    df = Counter(t for c in terms.values() for t in c)
    mean = sum(sum(c.values()) for c in terms.values()) / len(terms)
    want = []
    for q in sorted(i for i in terms if i % 4 == 0):
        scores = []
        for i, c in terms.items():
            n = sum(c.values())
            s = sum(math.log1p((len(terms) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * n / mean)) for t in terms[q] if t in c)
            if i != q and s > 0:
                scores.append((-s, i))
        want += [(q, k + 1, i, round(-s, 6)) for k, (s, i) in enumerate(sorted(scores)[:5])]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert sum(g[2] != w[2] for g, w in zip(got, want, strict=True)) == 0
    assert search.top_k(docs, docs.select(F.col("doc_id").alias("query_id"), "text")).count() > 0
    assert search.top_k(empty, empty.select(F.col("doc_id").alias("query_id"), "text")).count() == 0


# 10 -----------------------------------------------------------------------------------------------------------------


def test_language(spark, docs, empty, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = language.train(*language.labelled_windows(table.filter(~language.held_out())))
    out = language.predict(table, net).withColumn("held", language.held_out()).filter("held").select("lang", "lang_pred", "score").collect()
    assert len(out) > 20 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)
    mine = language.predict(docs.withColumn("lang_pred", F.lit(1)), net)
    assert mine.count() == docs.count()
    got = {r["text"]: r["lang_pred"] for r in mine.select("text", "lang_pred").collect()}
    assert got[None] == got[""] == got[" \n\t "] == "und" and got["a" * 500] in net.languages
    assert language.predict(empty, net).count() == 0
    assert language.train([], []) is None and language.labelled_windows(empty) == ([], [])
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}


def test_folded_network():
    """The scorer's tables give what the network's own layers give."""
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 110, 200).astype(np.uint8)) for _ in range(40)]
    net = language.train(texts, ["a" if i % 2 else "b" for i in range(40)], steps=5)
    x = language.padded(texts)
    e = net.embed[x]
    pooled = [(np.concatenate([e[:, j : language.WINDOW - w + 1 + j] for j in range(w)], axis=2) @ f).max(axis=1) + b for w, f, b in zip(language.WIDTHS, net.filters, net.bias, strict=True)]
    want = language.softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ net.out + net.out_bias)
    assert np.allclose(language.Scorer(net)(x), want, atol=1e-4)


