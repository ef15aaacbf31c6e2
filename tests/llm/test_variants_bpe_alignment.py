"""Spelling variants, byte-level BPE and token alignment: against brute force and the public libraries, with nulls, empty and repeated rows, ties and long texts."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stagelens.llm import alignment, byte_bpe, variants

P = pytest.importorskip("public_tokenizers")
RANKS, JSON, MODEL = (P.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, word string, row string"
ALPHABET = ["a", "b", " ", "\n", "\t", "!", "1", "é", "\x1c", "\x85", "　", "'s", "日", "🎉", "'", "▁", "Z"]


def odd_texts(seed, n):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)]
    words = ["naïve", "café", "running", "runing", "tokenizers", "<|endoftext|>", "</s>", "<unk>", "<0x41>", "don't", "1234567", "  ", "\n\n"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(n // 4)]
    return [None, "", " ", "a" * 700, "ab" * 300 + " " + "é" * 200, *texts]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0, "clash", "clash", "clash") for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    texts = odd_texts(5, 120)
    return [*enumerate(texts), (None, "a row without id"), (3, "a second three"), (7, texts[7]), (None, None)]


# 12 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_every_code_point(reference):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 97 == 0)]
    texts = [f"a{chr(c)}{chr(c)}b1{chr(c)} !{chr(c)} {chr(c)}" for c in points]
    bpe = byte_bpe.ByteBpe.of(RANKS, P.PATTERN)
    assert [np.frombuffer(x, np.int32).tolist() for x in bpe.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("seed", range(8))
def test_bpe_rows_and_heap_agree(seed, reference):
    """The matrices merge as the heap and the library do, whatever the length."""
    rng = random.Random(seed)
    bpe = byte_bpe.ByteBpe.of(RANKS, P.PATTERN)
    words = ["".join(rng.choice("aabcdest") for _ in range(rng.randrange(2, 250))).encode() for _ in range(60)]
    by_rows = [np.frombuffer(x, np.int32).tolist() for x in bpe.merge(words)]
    assert by_rows == [bpe.merge_long(w).tolist() for w in words] == [reference.encode_ordinary(w.decode()) for w in words]


def test_bpe_forgets_and_cuts_without_change(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_UNITS", 20)
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 100)
    monkeypatch.setattr(byte_bpe, "UNITS_AT_ONCE", 3)
    texts = odd_texts(9, 200)
    with open(RANKS, "rb") as f:
        bpe = byte_bpe.ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, P.PATTERN)
    assert [np.frombuffer(x, np.int32).tolist() for x in bpe.encode(texts)] == [reference.encode_ordinary(t or "") for t in texts]


def test_bpe_query(spark, rows, reference):
    got = byte_bpe.encoded_digests(frame(spark, rows), RANKS, P.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def want(t):
        ids = reference.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert Counter(tuple(r) for r in got.collect()) == Counter((d, *want(t)) for d, t in rows)
    assert byte_bpe.encoded_digests(frame(spark, []), RANKS, P.PATTERN).count() == 0


# 13 -----------------------------------------------------------------------------------------------------------------


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(JSON)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters, names = alignment.byte_letters(), {i: w for w, i in first.get_vocab().items()}
    found, counts = [], Counter()
    for doc, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text, num_threads=1)
            raw_a = [bytes(letters[c] for c in names[i]) for i in a]
            raw_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                i = j = i0 = j0 = x = y = 0
                while i < len(a):
                    links.append((a[i], b[j]))
                    end_a, end_b = x + len(raw_a[i]), y + len(raw_b[j])
                    if end_a <= end_b:
                        i, x = i + 1, end_a
                    if end_b <= end_a:
                        j, y = j + 1, end_b
                    if end_a == end_b:
                        groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
                        i0, j0 = i, j
            else:
                a, b = [], []
        found.append((doc, len(a), len(b), groups, links))
        counts.update(links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return Counter((d, na, nb, len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), sha(g)) for d, na, nb, g, k in found)


def test_alignment_against_the_libraries(spark, rows):
    got = alignment.align(frame(spark, rows), JSON, MODEL, P.PATTERN)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain_alignment(rows)
    assert alignment.align(frame(spark, []), JSON, MODEL, P.PATTERN).count() == 0


def test_alignment_of_long_documents_in_ranges(spark, rows, monkeypatch):
    """Documents in parts, byte ranges and rounds of the tree, the counts joined by shuffle: the same rows."""
    for name, value in (("LONG", 60), ("PART", 50), ("RANGE", 23), ("FAN", 3), ("SENT_PAIRS", 0)):
        monkeypatch.setattr(alignment, name, value)
    some = [r for r in rows if r[1] is None or len(r[1]) < 800][:60] + [(500, None), (501, "naïve café running " * 20), (501, "naïve café running " * 20)]
    assert Counter(tuple(r) for r in alignment.align(frame(spark, some), JSON, MODEL, P.PATTERN).collect()) == plain_alignment(some)


def random_tokens(rng, n):
    ends = [np.unique([rng.randrange(1, n) for _ in range(rng.randrange(1, n))] + [n]) for _ in range(2)]
    return alignment.Tokens(np.arange(len(ends[0])), ends[0], np.arange(len(ends[1])), ends[1])


@pytest.mark.parametrize("seed", range(40))
def test_fragments_compose_associatively(seed):
    rng = random.Random(seed)
    t = random_tokens(rng, 60)
    cuts = [0, *sorted(rng.randrange(1, 60) for _ in range(rng.randrange(0, 9))), 60]
    parts = [alignment.Fragment.of(t.between(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def plain(f):
        tokens = lambda t: [x.tolist() for x in (t.a, t.a_end, t.b, t.b_end)]
        whole = alignment.Tokens.none()
        for c in f.closed:
            whole = whole.then(c)
        return f.cut, tokens(f.prefix), tokens(whole), tokens(f.suffix)

    left, right = parts[0], parts[-1]
    for p in parts[1:]:
        left = left.then(p)
    for p in parts[-2::-1]:
        right = p.then(right)
    empty = alignment.Fragment.of(alignment.Tokens.none())
    whole = plain(alignment.Fragment.of(t))
    assert plain(left) == plain(right) == plain(alignment.composed(parts)) == plain(empty.then(left)) == plain(left.then(empty)) == whole


# 11 -----------------------------------------------------------------------------------------------------------------


def plain_variants(rows, shortest=5, least=3):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if n >= least and len(w) >= shortest}
    near = {w: [o for o in counts if variants.one_apart(w, o)] for w in counts}
    form = {w: min(x, key=lambda o: (-counts[o], o)) for w, x in near.items() if x}
    form = {w: o for w, o in form.items() if counts[o] >= 2 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items())


def test_one_apart():
    assert variants.one_apart("abc", "abd") and variants.one_apart("abc", "abcd") and variants.one_apart("xabc", "abc") and variants.one_apart("", "a")
    assert not any(variants.one_apart(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "abcde"), ("", ""), ("ab", "ba")))


@pytest.mark.parametrize("seed", range(6))
def test_trie_and_matrix(seed):
    """The trie reaches every pair that is one apart, and the matrix tells the same pairs as the plain rule."""
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abqrÀé") for _ in range(rng.randrange(1, 7))) for _ in range(150)} | {"a" * n for n in (14, 15, 16, 17, 18, 39, 40, 41, 42)} | {"a" * 39 + "b"})
    counts, matrix, zero = variants.vectors(words), variants.Words(words), np.zeros(len(words), np.int64)
    i, j = variants.Trie(zero, counts).search(zero, counts, zero + 1, zero + 1)
    every = {(a, b) for a in range(len(words)) for b in range(len(words)) if variants.one_apart(words[a], words[b])}
    assert every <= set(zip(i.tolist(), j.tolist(), strict=True))
    ok = matrix.near(matrix, i, j)
    assert set(zip(i[ok].tolist(), j[ok].tolist(), strict=True)) == every


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcÀéqr") for _ in range(rng.randrange(5, 8))) for _ in range(120)] + ["a" * n for n in (15, 16, 17, 60, 61)]
    text = lambda: " ".join(rng.choice(base) for _ in range(900))
    return [(None, text()), (None, None), (4, ""), (4, text()), (5, "ZZZZZ zzzzz zzzzy ZZZZY zzzzy Zzzzz"), (5, "ZZZZZ zzzzz zzzzy ZZZZY zzzzy Zzzzz"), (6, "1234 ,.;")]


@pytest.mark.parametrize(("levels", "split"), [(None, variants.SPLIT_WORDS), (3, 5), (9, 1)])
def test_variants_against_all_pairs(spark, spelled, levels, split):
    got = variants.variant_groups(frame(spark, spelled), levels=levels, split_words=split)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == plain_variants(spelled)


def test_variants_in_blocks(spark, spelled, monkeypatch):
    """Rows of one prefix in many blocks: its words stay for later calls."""
    monkeypatch.setattr(variants, "AT_ONCE", 8)
    assert sorted(tuple(r) for r in variants.variant_groups(frame(spark, spelled).coalesce(1), levels=1).collect()) == plain_variants(spelled)
    assert variants.variant_groups(frame(spark, [(1, None)])).count() == 0 == variants.variant_groups(frame(spark, [])).count()


def test_roots_of_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w3")]
    got = dict(variants.with_roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {w: "w37" for w, _ in chain}
