"""Where an operator once did less than its whole job."""

import numpy as np

import corpus_pipeline
from sparkloom.llm import linededup, secret_scan, simhash


def _words(rng, n: int) -> list[str]:
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


def _family(rng, rows: int, similarity: float, common: int = 240) -> list[str]:
    """Texts of which each pair has that Jaccard similarity of five-word shingles: a common passage, then words of their own."""
    own = round(common * (1 - similarity) / similarity / 2)
    template = _words(rng, common + 4)
    return [" ".join(template + _words(rng, own)) for _ in range(rows)]


def _groups(spark, texts: list[str]) -> dict[int, int]:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}


def test_near_dedup_keeps_texts_of_a_template(spark):
    rng = np.random.default_rng(1)
    texts = [t for s in (0.5, 0.6, 0.7) for t in _family(rng, 400, s)]
    assert all(k == v for k, v in _groups(spark, texts).items())


def test_near_dedup_finds_pairs_at_the_bound(spark):
    rng = np.random.default_rng(2)
    got = _groups(spark, [t for _ in range(300) for t in _family(rng, 2, 0.8)])
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(300)) >= 299
    assert all(v in (k, k - k % 2) for k, v in got.items())


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")
    rows = [(3, a), (5, f"{a}\nrest"), (5, f"{b}\nends"), (None, c), (None, f"{d}\n{c}"), (None, f"x\ny\n{b} z"), (9, f"{c}\n{d}")]
    docs = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(rows)], "doc_id long, n int, text string")
    got = {r["n"]: (r["text"], r["lines_removed"]) for r in linededup.dedup_lines(docs.coalesce(1)).collect()}
    assert got == {0: (a, 0), 1: ("rest", 1), 2: (f"{b}\nends", 0), 3: (c, 0), 4: (d, 1), 5: (f"x\ny\n{b} z", 0), 6: ("", 2)}


def test_stages_judge_rows_without_an_id_by_their_text(spark, tmp_path):
    rng = np.random.default_rng(3)
    item, *clean = (" ".join(_words(rng, 40)) for _ in range(6))
    rows = [(None, item), (None, clean[0]), (None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (7, item), (8, clean[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["text"] for r in near.collect()) == sorted([item, *clean])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted(r["text"] for r in left.collect()) == sorted([clean[0], *clean])


def test_near_dedup_keeps_true_pairs_within_a_dense_family(spark):
    rng = np.random.default_rng(4)
    family = _family(rng, 300, 0.6)
    near = [t.rsplit(" ", 10)[0] + " " + " ".join(_words(rng, 10)) for t in family[:50]]  # 310 of 330 shingles are shared
    got = _groups(spark, family + near)
    assert all(got[300 + i] == got[i] == i for i in range(50)) and all(got[i] == i for i in range(50, 300))


def test_secret_scan_reads_keys_and_lines_around():
    secret = "qX9vT2mK7pLw4ZcR8nBd"
    texts = [f"DB_PWD={secret}", f"AWS_ACCESS_KEY={secret}", f"credential={secret}", f"client_secret_value={secret}", f"{secret} is the credential",
             f"the credential\n{secret}\n", f"{secret}\nis the credential", "the credential" + " of ours" * 12 + f" {secret}", f"pwd:{secret}=="]
    for text in texts:
        found = secret_scan.novel_spans(text, secret_scan.base_spans(text), secret_scan.Novelty())
        assert [text[s:e].rstrip("=") for s, _, e in found] == [secret], text
    assert secret_scan.novel_spans(f"{secret}\n\n\nthe credential", [], secret_scan.Novelty()) == []
    assert [x[0] for x in secret_scan.novel_spans("DB_PWD=qX9vT2mK7p", [], secret_scan.Novelty())] == [7]


def test_line_dedup_rows_of_one_id_do_not_multiply(spark):
    lines = [[" ".join(f"{x}{i}{j}" for j in range(3)) for i in range(30)] for x in "abcd"]
    rows = [(1, lines[0])] * 3 + [(None, lines[1])] * 3 + [(2, lines[2] + lines[0][4:20]), (3, lines[3] + lines[2][1:9] + lines[3][:2])]
    docs = spark.createDataFrame([(k, i, "\n".join(x)) for i, (k, x) in enumerate(rows)], "doc_id long, n int, text string")
    got = {r["n"]: r["lines_removed"] for r in linededup.dedup_lines(docs.coalesce(1)).collect()}
    assert got == {0: 0, 1: 30, 2: 30, 3: 0, 4: 30, 5: 30, 6: 16, 7: 8}


def test_suffix_levels_are_a_suffix_array(spark):
    rng = np.random.default_rng(8)
    rows = [[int(x) for x in rng.integers(0, 3, rng.integers(1, 40))] for _ in range(12)] + [[7, 8, 9, 7, 8, 9, 7, 8, 9, 7]]
    docs = spark.createDataFrame([(r, r, a, x) for r, xs in enumerate(rows) for a, x in enumerate(xs)], "row long, by long, at int, id long")
    depth = 0
    for size, level in linededup.suffix_levels(docs):
        blocks = {(r, a): tuple(xs[a : a + size]) for r, xs in enumerate(rows) for a in range(len(xs) - size + 1)}
        members = {}
        for place, block in blocks.items():
            members.setdefault(block, []).append(place)
        got = {(r["row"], r["at"]): (r["rank"], r["later"]) for r in level.collect()}
        assert set(got) == {p for v in members.values() if len(v) > 1 for p in v}
        ranks = {}
        for p, (rank, later) in got.items():
            assert ranks.setdefault(rank, blocks[p]) == blocks[p] and later == (p != min(members[blocks[p]]))
        assert [ranks[r] for r in sorted(ranks)] == sorted(set(ranks.values()))
        depth = size
    assert depth * 2 > max(size for size in range(1, 40) if any(len(set(v)) > 1 for v in [[(r, a) for r, xs in enumerate(rows) for a in range(len(xs) - size + 1) if xs[a : a + size] == b] for b in [ys[c : c + size] for ys in rows for c in range(len(ys) - size + 1)]]))


def test_frequent_lines_are_joined_where_they_are(spark):
    docs = spark.createDataFrame([(i, f"own {i} first\nthe common line that many documents of all sources carry around\nown {i} last") for i in range(1500)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert sum("common" in t for t in got.values()) == 1 and "common" in got[0] and all(f"own {i} first" in t and f"own {i} last" in t for i, t in got.items())


def _flipped(rng, words: np.ndarray, bits: int) -> np.ndarray:
    out = np.unpackbits(words.view(np.uint8))
    out[rng.choice(len(out), bits, replace=False)] ^= 1
    return np.packbits(out).view(np.uint64)


def test_near_dedup_trees_find_what_meets_in_a_shard(spark):
    rng = np.random.default_rng(7)
    lanes = simhash.TREE_WORDS + simhash.SHARD_WORDS
    first = [rng.integers(0, 1 << 63, lanes).astype(np.uint64) for _ in range(40)]
    fps = first + [_flipped(rng, w, 120) for w in first] + [_flipped(rng, w, 500) for w in first]
    nodes = spark.createDataFrame([(i, i, 100, w.tobytes()) for i, w in enumerate(fps)], "node long, known long, size int, fp binary")
    large = spark.createDataFrame([], "large long, chunks int")
    keyed = simhash._projected(nodes, 8)
    found = {}
    for r in simhash._tree_groups(simhash._dealt(keyed, large, 4)).collect():
        found.setdefault(r["group"], set()).add(r["node"])
    shards = {}
    for r in keyed.collect():
        shards.setdefault(r["key"], []).append(r["node"])
    close = {(a, b) for m in shards.values() for a in m for b in m if a < b and np.bitwise_count(fps[a][: simhash.TREE_WORDS] ^ fps[b][: simhash.TREE_WORDS]).sum() <= simhash.RADIUS}
    assert close >= {(i, i + 40) for i in range(40)}
    assert all(any({a, b} <= g for g in found.values()) for a, b in close)
    assert all(any((min(a, b), max(a, b)) in close for b in g if b != a) for g in found.values() for a in g)


def test_near_dedup_has_its_links_from_the_trees(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = _family(rng, 2, 0.9) + _family(rng, 2, 0.3)
    assert _groups(spark, texts) == {0: 0, 1: 0, 2: 2, 3: 3}
    trees = simhash._tree_groups
    monkeypatch.setattr(simhash, "_tree_groups", lambda dealt: trees(dealt).where("false"))
    assert _groups(spark, texts) == {i: i for i in range(4)}


def test_near_dedup_shards_leave_few_pairs_apart():
    rng = np.random.default_rng(9)
    for n, own, bits in ((5, 1, 8), (15, 3, 8), (270, 30, 11)):
        apart = simhash.shards_for(bits, simhash.DIFFERS_SHORT if n <= simhash.SHORT else simhash.DIFFERS, 0.01)
        choice = [rng.choice(64 * simhash.SHARD_WORDS, bits, replace=False) for _ in range(apart)]
        missed = 0
        for _ in range(300):
            h = rng.integers(0, 1 << 63, n + own).astype(np.uint64)
            x, y = (simhash.wide_fingerprint(s) for s in ((h[:n], h[own:]) if n > 15 else (h[:n], h[: n - own])))
            assert np.bitwise_count(x[: simhash.TREE_WORDS] ^ y[: simhash.TREE_WORDS]).sum() <= (simhash.RADIUS_SHORT if n <= simhash.SHORT else simhash.RADIUS)
            differ = np.unpackbits((x ^ y)[simhash.TREE_WORDS :].view(np.uint8))
            missed += all(differ[c].any() for c in choice)
        assert missed <= 9
