"""op11 to op13 against brute force, and on their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import alignment, importance, overlap_join, queries

SCHEMA = "doc_id long, text string, row long, bucket int, rank string, pair int, n int, id string, score string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "r", 3, 4, "i", "s") for i, t in rows], SCHEMA)


# ---- op12


def _words(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (text or "").translate(LOWER))


def _scores(docs, target, ngram=1, buckets=10_000, percent=10, least=20):
    def count(text):
        w = _words(text)
        grams = [" ".join(w[i : i + n]) for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]
        return len(w), Counter(zlib.crc32(g.encode()) % buckets for g in grams)

    own = [(i, *count(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, c in own:
        s.update(c)
    for x in target:
        t.update(count(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for i, n, c in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(k * gain(b) for b, k in c.items())
        out.append([i, n, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return [(r[0], *r[2:], rank.get(id(r))) for r in out]


def _key(row):
    return tuple((x is not None, x or 0) for x in row)


def test_op12_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = [tuple(r) for r in queries.op12_importance_resampling(spark, sf).collect()]
    assert sorted(got, key=_key) == sorted(_scores(docs, target), key=_key)


@pytest.mark.parametrize("ngram", [1, 3])
def test_op12_cases(spark, ngram):
    hot = "the cat sat on the mat and the dog " * 4
    rows = [(1, None), (2, ""), (3, " .,\n"), (None, hot), (None, hot), (5, hot), (5, hot), (6, "ÀÉ ß Straße 12a" * 30), (7, "x" * 300_000 + " y" * 50), (8, "A\u0000b c")]
    rows += [(i, hot + f" w{i} v{i % 7}") for i in range(10, 60)]
    target = [None, "", "the cat w11 w12", "ß straße"]
    aim = frame(spark, list(enumerate(target)))
    got = [tuple(r) for r in importance.resample(frame(spark, rows), aim, percent=30, ngram=ngram, buckets=500).collect()]
    assert sorted(got, key=_key) == sorted(_scores(rows, target, ngram, 500, 30), key=_key)
    none = frame(spark, [])
    assert importance.resample(none, aim).collect() == []
    got = [tuple(r) for r in importance.resample(frame(spark, rows), none).collect()]
    assert sorted(got, key=_key) == sorted(_scores(rows, []), key=_key)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="aB z9é.\n\u0000", max_size=90), min_size=1, max_size=5), st.integers(1, 3))
def test_op12_features(texts, ngram):
    words, owner, bucket = importance.features(pa.array(texts), ngram)
    want = Counter()
    for i, t in enumerate(texts):
        w = _words(t)
        assert words[i] == len(w)
        want.update((i, zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000) for n in range(1, ngram + 1) for k in range(len(w) - n + 1))
    assert Counter(zip(owner.tolist(), bucket.tolist())) == want


# ---- op13


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def _byte_values():
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in plain]
    return {chr(i): i for i in plain} | {chr(256 + k): i for k, i in enumerate(rest)}


def _tokens(tokenizers, text):
    a, b = tokenizers
    if not text:
        return [], []
    values = _byte_values()
    left = [(i, bytes(values[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == b"".join(x for _, x in right) == whole else ([], [])


def _aligned(left, right, kind):
    """(links as pairs of ids, groups): by walking both sides."""
    ends = []
    for side in (left, right):
        at, got = 0, []
        for _, x in side:
            got.append((at, at + len(x)))
            at += len(x)
        ends.append(got)
    shared = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
    groups, low = [], 0
    for e in shared:
        groups.append(([i for (i, _), (s, t) in zip(left, ends[0]) if low < t <= e], [i for (i, _), (s, t) in zip(right, ends[1]) if low < t <= e]))
        low = e
    if kind == "groups":
        found = [(i, j) for x, y in groups for i in x for j in y]
    else:
        meets = {"ends": lambda p, q: p[1] == q[1], "overlaps": lambda p, q: p[0] < q[1] and q[0] < p[1]}[kind]
        found = [(i, j) for (i, _), p in zip(left, ends[0]) for (j, _), q in zip(right, ends[1]) if meets(p, q)]
    return found, ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def _alignment(tokenizers, rows, kind="ends"):
    every = []
    for i, text in rows:
        left, right = _tokens(tokenizers, text)
        every.append((i, left, right, *_aligned(left, right, kind)))
    counts = Counter(p for *_, found, _ in every for p in found)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, left, right, found, groups in every:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((i, len(left), len(right), groups.count("|"), len(found), sum(counts[p] == most[p[1]] for p in found), sum(counts[p] for p in found), digest))
    return out


CASES = [
    (1, None), (2, ""), (3, " "), (4, "one two three"), (4, "one two three"), (None, "one two three"), (None, None), (5, "a<|endoftext|>b </s> <unk>"), (6, "a ▁ b"), (7, "ﬁ ＡＢ ½ 😀 ß\u0000x"),
    (8, "tab\there  two\n\nlines \n x"), (9, "ab" * 2000), (10, "word " * 400), (11, "première ligne\ndeuxième ligne\nАлфавит"), (12, "internationalisation tokenizers")
]


@pytest.mark.parametrize("common", [alignment.COMMON, 1, 20])
def test_op13_cases(spark, tokenizers, common):
    got = [tuple(r) for r in alignment.align_documents(frame(spark, CASES), common=common).collect()]
    assert sorted(got, key=_key_text) == sorted(_alignment(tokenizers, CASES), key=_key_text)
    assert alignment.align_documents(frame(spark, [])).collect() == []


def _key_text(row):
    return tuple((x is not None, str(x)) for x in row)


@pytest.mark.parametrize("kind", ["overlaps", "groups"])
def test_op13_other_links(spark, tokenizers, kind):
    rows = [r for r in CASES if r[0] not in (9, 10)]
    got = [tuple(r) for r in alignment.align_documents(frame(spark, rows), kind=kind).collect()]
    assert sorted(got, key=_key_text) == sorted(_alignment(tokenizers, rows, kind), key=_key_text)


def test_op13_against_the_tokenizers(spark, sf, tokenizers):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r["text"] or "") < 1500]
    got = [tuple(r) for r in alignment.align_documents(frame(spark, docs)).collect()]
    assert sorted(got, key=_key_text) == sorted(_alignment(tokenizers, docs), key=_key_text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.randoms(use_true_random=False))
def test_op13_intervals(sizes, rng):
    ends = np.cumsum(sizes)
    other = np.array(sorted({*rng.sample(range(1, int(ends[-1]) + 1), rng.randint(0, int(ends[-1]) - 1)), int(ends[-1])}))
    end, a, b, closed = alignment.elementary(ends, other)
    starts = lambda e: np.concatenate(([0], e[:-1]))
    want = {(i, j) for i in range(len(ends)) for j in range(len(other)) if starts(ends)[i] < other[j] and starts(other)[j] < ends[i]}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)
    assert end[closed].tolist() == sorted(set(ends.tolist()) & set(other.tolist()))


# ---- op11


def _set(text, size=5):
    w = re.findall("[^\\x20\\x09-\\x0D]+", (text or "").translate(LOWER))
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def _components(rows, size=5, percent=80):
    sets = [_set(t, size) for _, t in rows]
    at = {}
    for k, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        shared = Counter(y for x in s for y in at[x] if y < k)
        for y, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[y]) - n):
                root[max(find(k), find(y))] = min(find(k), find(y))
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(-1 if i is None else i)
    low = {k: min(v) for k, v in least.items()}
    return [(i, len(sets[k]), None if low[find(k)] == -1 else low[find(k)]) for k, (i, _) in enumerate(rows)]


def _joined(spark, rows, **more):
    return sorted((tuple(r) for r in overlap_join.join_similar(frame(spark, rows), **more).collect()), key=_key)


def test_op11_cases(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(9, text), (4, text), (4, text.upper() + " more"), (None, None), (3, None), (2, ""), (1, " \n\t "), (7, "a b c d"), (8, "A  B\tc\nd"), (6, "a b c d e"), (5, "a b c"), (11, "ÀB c d e f"), (12, "àB c d e f"),
            (20, "z"), (None, "z"), (21, "x" * 300_000), (22, "x" * 300_000), (23, "la " * 100_000), (24, "la la la la la"), (25, "a b\u0085c d e f\u0000"), (26, "\x1c \x1f")]
    want = sorted(_components(rows), key=_key)
    assert _joined(spark, rows) == want
    assert (None, 1, None) in want and (20, 1, None) in want and (24, 1, 23) in want
    assert overlap_join.join_similar(frame(spark, [])).collect() == []
    assert _joined(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def _family(rng, n, words, edits, copies=0):
    base = [f"b{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out + out[:1] * copies


@pytest.mark.parametrize("chunk", [512, 7])
def test_op11_families_in_parts(spark, monkeypatch, chunk):
    """Groups of near copies on both sides of the bar, of many exact copies, and a passage that many texts share."""
    monkeypatch.setattr(overlap_join, "GROUP_ROWS", chunk)
    monkeypatch.setattr(overlap_join, "LIST_ROWS", 5 if chunk == 7 else 2048)
    rng = random.Random(chunk)
    texts = _family(rng, 60, 100, 3, 30) + _family(rng, 40, 60, 5) + _family(rng, 50, 30, 2) + _family(rng, 30, 12, 1)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([5, 12, 15, 30]))) for _ in range(80)]
    chain = [f"c{i}" for i in range(50)]
    for _ in range(40):
        texts.append(" ".join(chain))
        chain = chain[2:] + [f"c{rng.randrange(10**6)}", f"c{rng.randrange(10**6)}"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert _joined(spark, rows) == sorted(_components(rows), key=_key)


@pytest.mark.parametrize(("size", "percent"), [(1, 50), (3, 60), (2, 95), (1, 100)])
def test_op11_other_bars(spark, size, percent):
    rng = random.Random(size * percent)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 9)))) for i in range(150)]
    assert _joined(spark, rows, size=size, percent=percent) == sorted(_components(rows, size, percent), key=_key)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=14), st.sampled_from([50, 80, 100]), st.integers(0, 14))
def test_op11_searches(sets, percent, cut):
    """All links, of one shard and of two sides that meet; cut is where the second side begins."""
    cut = min(cut, len(sets))
    for side in ([0] * len(sets), [2] * cut + [1] * (len(sets) - cut)):
        owner = np.concatenate([np.full(len(s), k) for k, s in enumerate(sets)])
        value = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
        n = np.array([len(s) for s in sets])
        x, y = overlap_join.occurrences(owner, value, n, np.array(side), np.arange(len(sets)), percent)
        want = [(i, j) for i in range(len(sets)) for j in range(i) if side[i] + side[j] in (0, 3) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        groups = lambda pairs: _roots(len(sets), pairs)
        assert groups(zip(x.tolist(), y.tolist())) == groups(want)
        assert {(max(p), min(p)) for p in zip(x.tolist(), y.tolist())} <= set(want)


def _roots(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        ra, rb = root[a], root[b]
        root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return root


def test_op11_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op11_jaccard_join(spark, sf).collect()), key=_key)
    assert got == sorted(_components(rows), key=_key) and len({r[2] for r in got}) < len(rows)


@pytest.mark.parametrize("scale", [10, 3000, 90_000])
def test_op11_bitmaps_never_exceed_the_difference(scale):
    rng = np.random.default_rng(scale)
    sets = [np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)) for size in (scale, scale + scale // 5)]
    sets += [np.unique(np.concatenate((sets[0][: scale - scale // 10], rng.integers(0, 2**63, scale // 10 + 1, dtype=np.uint64))))]
    size = np.array([len(s) for s in sets])
    maps = []
    for s, w in zip(sets, overlap_join.bitmap_bits(size).tolist()):
        parity = np.bincount((s & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1
        maps.append(np.packbits(parity.astype(np.uint8), bitorder="little").tobytes())
    x, y = np.array([1, 2, 2]), np.array([0, 0, 1])
    differ = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y)])
    got = overlap_join.apart(maps, size, x, y)
    assert (got <= differ).all() and ((differ - got) % 2 == 0).all()
    assert scale < 1000 or got[0] > 0.3 * size[0] > got[1]
