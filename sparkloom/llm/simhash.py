"""SimHash near-duplicates: fingerprints, exact Hamming links by vantage-point trees, groups.

Texts become 64-bit fingerprints; two texts link when their fingerprints differ in at most ``radius`` bits; groups are
the connected components of the links. Equal fingerprints are one node from the start, so a group of copies costs one
row after a partial aggregation, however large it is.

Exact pairs. The metric space is cut in shards: with b blocks of bits, fingerprints within radius r agree on at least
b - r blocks, so for each choice of b - r blocks all fingerprints whose projection has distance zero meet in one shard,
and a fingerprint goes to every shard that its ball touches (boundary overlap). No pair can be lost. Every shard, of any size, is
searched by a vantage-point tree of its own: it partitions by Hamming distance to a vantage point at the median distance, and a range search
prunes a branch whenever the triangle bound excludes it. A shard gives only the edges of a spanning forest of its own links,
so what leaves it is linear in its size. Shards over ``shard_rows`` rows are split into chunks, and every pair of chunks
is searched in its own task, so no group is gathered in one task whatever its size. A chunk has between ``shard_rows``
and CHUNK_MOST rows.

Where groups are wanted by a similarity, similar_rows goes the same way with wider fingerprints: shards are projections with distance zero,
as many as it takes for pairs of that similarity to meet, each is searched by its own vantage-point tree, and as a fingerprint can't
tell similarity 0.8 from 0.6, what the trees find is tested exactly.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ROW, map_arrow, numbered, ship, spread_join, stash, text_slices, unstash
from .words import mix

SEED = 42
#: Most fingerprints in one chunk of a large shard: half a megabyte.
CHUNK_MOST = 1 << 16
#: Large shards are broadcast up to this number of them (a few megabytes), else joined by a shuffle.
LARGE_SHARDS = 200_000


def fingerprint_bytes(text: bytes, size: int = 4) -> int:
    """The fingerprint of one text: bit k is 1 if it is set in over half the hashes of its word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n)
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each row of docs; fp holds the unsigned bits in a long. Null text counts as empty."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                texts = pc.fill_null(part.column(1), "").cast(pa.binary()).to_pylist()
                fp = np.array([fingerprint_bytes(t, size) for t in texts], np.uint64)
                yield {"doc_id": part.column(0), "fp": pa.array(fp.view(np.int64))}

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs, step, f"doc_id {kind}, fp bigint", [id_col, text_col])


def blocks_for(rows: int, radius: int, shard_rows: int = 512) -> int:
    """How many blocks the bits are cut into, so that evenly spread fingerprints fill a shard with few rows."""
    for blocks in range(radius + 1, 2 * radius + 1):
        if rows / 2 ** (64 * (blocks - radius) / blocks) <= shard_rows / 8:
            return blocks
    return 2 * radius


def block_masks(blocks: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits, row by row; rows are one word or several."""
    bits = np.bitwise_count(x ^ y)
    return bits.astype(np.int64) if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


class VantageForest:
    """Exact range search by Hamming distance in many sets of fingerprints at once, of 64 bits or rows of several words: one vantage-point tree for each set.

    Each node holds one point of its set, the vantage point; the others are sorted by their distance to it and halved, and each half
    keeps its least and greatest distance. All trees are built level by level together.
    """

    def __init__(self, owner: np.ndarray, words: np.ndarray):
        """owner: the set of each point, 0, 1, ..., in ascending order."""
        self.words = words.view(np.uint64)
        n = len(words)
        self.point, self.low, self.high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.child = np.full((n, 2), -1, np.int64)
        order = np.arange(n)
        start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if n else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((start, [n])))
        self.roots = np.arange(len(start))
        node, made = self.roots, len(start)
        while len(start):
            vantage = order[start]
            self.point[node] = vantage
            rest = size > 1
            start, size, node, vantage = start[rest] + 1, size[rest] - 1, node[rest], vantage[rest]
            if not len(start):
                break
            set_of = np.repeat(np.arange(len(start)), size)
            at = np.arange(len(set_of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            d = _distance(self.words[order[at]], np.repeat(self.words[vantage], size, axis=0))
            by = np.lexsort((d, set_of))
            order[at], d = order[at][by], d[by]
            first = np.cumsum(size) - size
            half = (size + 1) // 2
            starts, sizes, nodes = [], [], []
            for side, (a, m) in enumerate(((np.zeros_like(half), half), (half, size - half))):
                some = m > 0
                new = made + np.arange(int(some.sum()))
                made += len(new)
                self.child[node[some], side] = new
                self.low[new], self.high[new] = d[(first + a)[some]], d[(first + a + m - 1)[some]]
                starts.append((start + a)[some])
                sizes.append(m[some])
                nodes.append(new)
            start, size, node = np.concatenate(starts), np.concatenate(sizes), np.concatenate(nodes)

    def links(self, owner: np.ndarray, queries: np.ndarray, radius: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of (query index, point index) within radius in the query's set; a query goes down every branch that its ball may touch."""
        queries = queries.view(np.uint64)
        todo = [(np.arange(a, min(a + most, len(queries))), self.roots[owner[a : a + most]]) for a in range(0, len(queries), most)]
        while todo:
            q, node = todo.pop()
            point = self.point[node]
            d = _distance(queries[q], self.words[point])
            close = d <= radius
            if close.any():
                yield q[close], point[close]
            near, far = self.child[node, 0], self.child[node, 1]
            goes = []
            for child in (near, far):
                # The triangle bound: points of the child are between low and high from the vantage point.
                touched = (child >= 0) & (d - radius <= self.high[child]) & (d + radius >= self.low[child])
                goes.append((q[touched], child[touched]))
            q, node = (np.concatenate(x) for x in zip(*goes))
            todo += [(q[a : a + most], node[a : a + most]) for a in range(0, len(q), most)]


def _forest(known: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest, taken from batches of links (a, b). Nodes of one known group are joined from the start."""
    return _joined(known, pairs)[1:]


def _joined(known: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The root of each node, and the links that _forest gives."""
    _, first, inverse = np.unique(known, return_index=True, return_inverse=True)
    root = first[inverse]
    kept_a, kept_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            order = np.lexsort((low, high))
            first = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
            root[high[first]] = low[first]
            kept_a.append(a[first])
            kept_b.append(b[first])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root, np.concatenate(kept_a), np.concatenate(kept_b)


def _shard_edges(shards: list[dict], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest within each shard (side 0), or between the two chunks of each pair (sides 1 and 2), by their trees."""
    node, word, side = (np.concatenate([g[n] for g in shards]) for n in ("node", "word", "side"))
    owner = np.repeat(np.arange(len(shards)), [len(g["node"]) for g in shards])
    _, known = np.unique(node, return_inverse=True)
    points, queries = np.flatnonzero(side != 1), np.flatnonzero(side != 2)
    # A pair of chunks may have rows of one side only.
    sets, of = np.unique(owner[points], return_inverse=True)
    queries = queries[np.isin(owner[queries], sets)]
    forest = VantageForest(of, word[points])
    x, y = _forest(known, ((queries[q], points[p]) for q, p in forest.links(np.searchsorted(sets, owner[queries]), word[queries], radius)))
    return node[x], node[y]


def _often(keys: DataFrame) -> DataFrame:
    """(key, n) of keys that a task has read twice or more; n falls short of the true count by one for each task at most."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_pydict({"key": key[n > 1], "n": n[n > 1].astype(np.int64)})

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) > 4_000_000:
                yield flush()
        if held:
            yield flush()

    return keys.mapInArrow(step, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _parts(spark, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 2_000_000)


def _dealt(keyed: DataFrame, large: DataFrame, parts: int) -> DataFrame:
    """Rows of keyed (key, node and others) with their side, a shard after the other. large: key and number of chunks of the shards that are split."""
    few = large.count() <= LARGE_SHARDS
    met = keyed.join(F.broadcast(large) if few else large, F.col("key") == F.col("large"), "left")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    met = met.withColumn("chunk", chunk).withColumn("other", F.explode(F.when(F.col("chunks") > 1, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.lit(-1)))))
    low, high = F.least(F.col("chunk"), F.col("other")), F.greatest(F.col("chunk"), F.col("other"))
    # A shard of few rows keeps its key; each pair of chunks of a large one is a key of its own.
    dealt = met.select(
        *[c for c in keyed.columns if c != "key"], F.when(F.col("other") < 0, F.col("key")).otherwise(F.xxhash64("key", low, high)).alias("key"),
        F.when((F.col("other") < 0) | (F.col("chunk") == F.col("other")), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"),
    )
    return dealt.repartition(parts, "key").sortWithinPartitions("key")


def _shards(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[dict]]:
    """Lists of whole shards of two rows or more, some ten thousand rows at once; rows come sorted by key."""

    def each() -> Iterator[dict]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names}
            # Signed numbers would give the bits of absolute values.
            cols = {n: v.view(np.uint64) if n.startswith("word") else v for n, v in cols.items()}
            if rest is not None:
                cols = {n: np.concatenate((rest[n], v)) for n, v in cols.items()}
            cuts = [0, *(np.flatnonzero(cols["key"][1:] != cols["key"][:-1]) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    yield {n: v[a:b] for n, v in cols.items()}
            rest = {n: v[cuts[-1] :] for n, v in cols.items()}
        if rest is not None and len(rest["node"]) > 1:
            yield rest

    held: list[dict] = []
    count = 0
    for g in each():
        held.append(g)
        count += len(g["node"])
        if count >= 1 << 15:
            yield held
            held, count = [], 0
    if held:
        yield held


def hamming_edges(nodes: DataFrame, radius: int = 4, rows: int | None = None, shard_rows: int = 512) -> DataFrame:
    """Links (a, b), a > b, whose connected components are those of all links. nodes: node and fp, distinct.

    A shard is named by a 64-bit hash of its number and cell; should two shards share a name, the distance still decides about each pair.

    Defined cases: no or one node, or nodes that are all far apart, give no link; node and fp may not be null, and no node may have two rows.
    """
    spark = nodes.sparkSession
    ship(spark)
    rows = nodes.count() if rows is None else rows
    blocks = blocks_for(rows, radius, shard_rows)
    masks = block_masks(blocks)
    choices = [sum(masks[k] for k in kept) for kept in itertools.combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in choices]
    cells = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)]
    parts = _parts(spark, rows * len(cells))
    keyed = nodes.repartition(parts, "node").select("node", F.col("fp").alias("word"), F.explode(F.array(*cells)).alias("key"))
    size = F.greatest(F.lit(shard_rows), F.least(F.lit(CHUNK_MOST), F.col("n") / 32))
    large = stash(_often(keyed.select("key")).where(F.col("n") > shard_rows).select(F.col("key").alias("large"), F.ceil(F.col("n") / size).cast("int").alias("chunks")), "large")
    dealt = _dealt(keyed, large, parts)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _shards(batches, ("key", "node", "word", "side")):
            a, b = _shard_edges(held, radius)
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return dealt.mapInArrow(step, "a bigint, b bigint").where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): smallest node reachable over edges (a, b). Alternating large-star and small-star steps.

    Every step is a partial aggregation and an equi-join; each round is written to the shared folder. Work follows the number of edges,
    not of nodes: nodes without an edge never enter.
    """
    now = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        nxt = stash(small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        unstash(now)
        now = nxt
        # Done when every node on the left has one node on the right, and none is on both sides.
        sides = now.select(F.col("a").alias("u"), F.col("b").alias("to")).union(now.select(F.col("b").alias("u"), F.lit(None).cast("bigint").alias("to")))
        seen = sides.groupBy("u").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max(F.col("to").isNull()).alias("right"))
        if seen.where(F.col("low").isNotNull() & ((F.col("low") < F.col("high")) | F.col("right"))).isEmpty():
            break
    else:
        raise RuntimeError("connected components did not converge")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


#: Words of a wide fingerprint: the first are searched by the trees, the bits of the others are projected to shards.
TREE_WORDS, SHARD_WORDS = 4, 16
WORDS = tuple(f"word{i}" for i in range(TREE_WORDS))
_LANES = mix(np.arange(1, TREE_WORDS + SHARD_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Most often that a bit differs at similarity 0.8, by count over all ways to share shingles: for texts of up to SHORT shingles, and for longer ones.
SHORT, DIFFERS_SHORT, DIFFERS = 5, 0.1875, 0.1612
#: A pair at similarity 0.8 meets in no shard with at most this probability.
UNMET = 1.5e-4
#: Bits of the trees' words that may differ, and between short texts: at 0.8 more do in at most 1 pair of 10,000.
RADIUS, RADIUS_SHORT = 65, 72
#: Fingerprints in a shard, if evenly spread.
SHARD_FILL = 32
#: One node in so many is counted to find large shards.
COUNTED = 16
#: Most texts that meet in one part of a large group.
GROUP_ROWS = 256


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted; a text of fewer words is one shingle."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(w) - size + 1)
    last = ends[size - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last)), np.uint64, n))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """Words of independent SimHash bits of a set of shingle hashes: a bit is 1 if it is set in over half the hashes of its word's lane."""
    counts = np.zeros(64 * len(_LANES), np.int64)
    for i in range(0, len(h), 2040):
        part = mix(h[i : i + 2040, None] ^ _LANES)
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            counts += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)


def shards_for(bits: int, differs: float, unmet: float = UNMET) -> int:
    """How many projections to that many bits leave a pair whose bits differ with probability differs apart in all of them with probability unmet at most."""
    total = 64 * SHARD_WORDS
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    d = range(total - bits + 1)
    weight = np.exp([choose(total, i) + i * math.log(differs) + (total - i) * math.log(1 - differs) for i in d])
    apart = 1 - np.exp([choose(total - i, bits) - choose(total, bits) for i in d])
    low, high = 1, 1 << 20
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if weight @ apart**mid <= unmet else (mid + 1, high)
    return low


def _projected(nodes: DataFrame, bits: int) -> DataFrame:
    """(key, node, known, short and WORDS): each node in its shards. A shard is a choice of bits of the fingerprint, the same for all, and their values."""
    long, short = shards_for(bits, DIFFERS), shards_for(bits, DIFFERS_SHORT)
    choice = np.argsort(np.random.default_rng(SEED).random((short, 64 * SHARD_WORDS)), axis=1)[:, :bits]
    power = 1 << np.arange(bits)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                node, known, size = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                words = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int64).reshape(part.num_rows, -1)
                flags = np.unpackbits(words[:, TREE_WORDS:].copy().view(np.uint8), axis=1, bitorder="little")
                for first, last, of in ((0, long, size > 0), (long, short, (size > 0) & (size <= SHORT))):
                    if of.any():
                        some = flags[of]
                        key = np.stack([some[:, choice[k]] @ power | k << 40 for k in range(first, last)], axis=1)
                        rest = [np.repeat(x[of], last - first) for x in (node, known, size <= SHORT, *words[:, :TREE_WORDS].T)]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.ravel(), *rest)], names=["key", "node", "known", "short", *WORDS])

    return nodes.select("node", "known", "size", "fp").mapInArrow(step, ", ".join(("key bigint, node bigint, known bigint, short boolean", *(f"{w} bigint" for w in WORDS))))


def _tree_groups(dealt: DataFrame) -> DataFrame:
    """(group, node, known, head), distinct: in each shard, the nodes that its tree joins by pairs of different known groups within RADIUS of each other.

    dealt: key, node, known, short, WORDS and side. A group is named by a hash of its members, so that one found in several shards is one; head is its smallest.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _shards(batches, ("key", "node", "known", "short", "side", *WORDS)):
            node, known, short, side, *words = (np.concatenate([g[n] for g in held]) for n in ("node", "known", "short", "side", *WORDS))
            word = np.stack(words, axis=1)
            owner = np.repeat(np.arange(len(held)), [len(g["node"]) for g in held])
            points, queries = np.flatnonzero(side != 1), np.flatnonzero(side != 2)
            # A pair of chunks may have rows of one side only.
            sets, of = np.unique(owner[points], return_inverse=True)
            queries = queries[np.isin(owner[queries], sets)]
            links = VantageForest(of, word[points]).links(np.searchsorted(sets, owner[queries]), word[queries], RADIUS_SHORT)

            def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                of = known[x] != known[y]
                x, y = x[of], y[of]
                of = (_distance(word[x], word[y]) <= RADIUS) | short[x] & short[y]
                return x[of], y[of]

            root, _, _ = _joined(np.arange(len(node)), (near(queries[q], points[p]) for q, p in links))
            many = np.bincount(root, minlength=len(node))[root] > 1
            if many.any():
                name = np.zeros(len(node), np.uint64)
                np.add.at(name, root[many], mix(node[many].view(np.uint64) + np.uint64(SEED)))
                head = np.full(len(node), np.iinfo(np.int64).max)
                np.minimum.at(head, root[many], node[many])
                yield pa.RecordBatch.from_pydict({"group": name[root[many]].view(np.int64), "node": node[many], "known": known[many], "head": head[root[many]]})

    return dealt.mapInArrow(step, "group bigint, node bigint, known bigint, head bigint").distinct()


def _families(found: DataFrame) -> DataFrame:
    """(group, node, known): groups of different shards that share members as one group, where that makes fewer rows in pairs of parts than the groups by themselves."""
    family = components(found.select(F.col("node").alias("a"), F.col("head").alias("b"))).select(F.col("node").alias("m"), "root")
    member = found.groupBy("node").agg(F.min("known").alias("known"), F.count(F.lit(1)).alias("times"))
    member = stash(member.join(family.hint("merge"), F.col("node") == F.col("m"), "left").select("node", "known", "times", F.coalesce("root", "node").alias("family")), "member")
    size = stash(member.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("rows")), "sizes")
    n = F.col("__right_n")
    told = stash(spread_join(member, size, ["family"], "n").withColumn("one", n * F.ceil(n / GROUP_ROWS) <= F.col("__right_rows")), "told")
    others = told.where("not one").select(F.col("node").alias("m"))
    rest = found.join(others.hint("merge"), F.col("node") == F.col("m"), "left_semi").select("group", "node", "known")
    return stash(told.where("one").select(F.xxhash64("family").alias("group"), "node", "known").union(rest), "families")


def exact_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j whose sets have Jaccard similarity of at least similarity, from exact counts of shared members."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts > 1
    place = np.cumsum(often) - 1
    inside = often[column]
    owner, column = owner[inside], place[column[inside]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    width = int(often.sum())
    for at in range(0, width, 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        part = np.zeros((len(sets), min(2048, width - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        shared += part @ part.T
    shared = shared.astype(np.int64)
    alike = shared >= (similarity - 1e-12) * (sizes[:, None] + sizes[None, :] - shared)
    return np.nonzero(np.triu(alike, 1))


def _verified(edges: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts are alike."""
    ends = [texts.select(F.col("node").alias(e), F.col("text").alias(f"text_{e}")) for e in ("a", "b")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            keep = [len(exact_links([shingle_set(x.as_py(), size), shingle_set(y.as_py(), size)], similarity)[0]) > 0 for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return edges.join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b").select("a", "b", "text_a", "text_b").mapInArrow(step, "a bigint, b bigint")


def _group_links(dealt: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) of a spanning forest of the verified pairs of each group. dealt: key, node, known, text, sorted by key."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.binary()))

        for _, group in itertools.groupby(rows(), key=lambda r: r[0]):
            found = list(group)
            known = np.array([r[2] for r in found], np.int64)
            if (known == known[0]).all():
                continue
            node = np.array([r[1] for r in found], np.int64)
            x, y = _forest(known, [exact_links([shingle_set(r[3].as_py(), size) for r in found], similarity)])
            if len(x):
                a, b = node[x], node[y]
                yield pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return dealt.mapInArrow(step, "a bigint, b bigint").distinct()


def similar_rows(docs: DataFrame, size: int = 5, similarity: float = 0.8, row_col: str = ROW, text_col: str = "text") -> DataFrame:
    """(row, root) for every row of docs, which a unique key row_col names: connected components of the pairs of texts whose
    word-shingle sets have Jaccard similarity of at least similarity.

    Texts of equal sets are one node with one wide SimHash fingerprint. A shard is a projection of fingerprints with distance zero; each
    fingerprint goes to several, so many that of pairs at 0.8 at most 2.5 in 10,000 meet in none or differ too much for the trees
    (by count of bits, whatever the number of rows). Every shard is searched by its own vantage-point tree, and no pair becomes a link, or spares
    another pair its test, before its exact similarity is known. In large shards each node is first tried with the smallest
    node of one of them, which joins large groups of near copies by one link a node; then all pairs are tried within the groups that the trees find.
    Joins whose sides grow with the documents are sorted merges at any size, so that a plan seen on a small table is that of a large one.

    Defined cases: null text counts as empty; texts without words are one node; a text of fewer words than size is one shingle; equal texts share a root;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                sets = [shingle_set(t, size) for t in pc.fill_null(part.column(1), "").cast(pa.binary()).to_pylist()]
                with np.errstate(over="ignore"):
                    digests = [np.array([mix(h + np.uint64(k)).sum(dtype=np.uint64) for h in sets], np.uint64).view(np.int64) for k in (1, 2)]
                yield {"row": part.column(0), "d0": pa.array(digests[0]), "d1": pa.array(digests[1]), "size": pa.array([len(h) for h in sets], pa.int32()), "fp": pa.array([wide_fingerprint(h).tobytes() for h in sets], pa.binary())}

    sketches = stash(map_arrow(docs, step, "row bigint, d0 bigint, d1 bigint, size int, fp binary", [row_col, text_col]), "sketches")
    heads = sketches.groupBy("d0", "d1").agg(F.min("row").alias("node")).withColumnsRenamed({"d0": "e0", "d1": "e1"})
    named = stash(sketches.select("row", "d0", "d1").join(heads, (F.col("d0") == F.col("e0")) & (F.col("d1") == F.col("e1"))).select("row", "node"), "nodes")
    nodes = stash(sketches.join(named.where("row = node").select("node").hint("merge"), F.col("row") == F.col("node")).select("node", "size", "fp"), "fingerprints")
    rows = nodes.count()
    bits = max(8, round(math.log2(max(rows, 1) / SHARD_FILL)))
    parts = _parts(spark, rows * shards_for(bits, DIFFERS))
    counted = _projected(nodes.where(F.pmod(F.xxhash64("node"), F.lit(COUNTED)) == 0).withColumn("known", F.col("node")), bits).groupBy("key").agg((F.count(F.lit(1)) * COUNTED).alias("n"))
    chunk = F.greatest(F.lit(SHARD_FILL * COUNTED), F.least(F.lit(CHUNK_MOST), F.col("n") / 32))
    large = stash(counted.where(F.col("n") > SHARD_FILL * COUNTED).select(F.col("key").alias("large"), F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "large")
    texts = docs.select(F.col(row_col).alias("node"), F.coalesce(text_col, F.lit("")).alias("text"))
    links, grouped = None, nodes.withColumn("known", F.col("node"))
    if not large.isEmpty():
        dense = stash(_projected(grouped, bits).join(large, F.col("key") == F.col("large")).select("key", "node", *WORDS), "dense")
        low = stash(dense.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", *WORDS)).alias("low")), "low")
        apart = sum(F.bit_count(F.col(w).bitwiseXOR(F.col(f"__right_low.{w}"))) for w in WORDS)
        near = spread_join(dense, low, ["key"], "n").where((F.col("node") > F.col("__right_low.node")) & (apart <= RADIUS_SHORT))
        star = near.groupBy("node", F.col("__right_low.node").alias("b")).agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max_by("b", "n").alias("b"))
        star = stash(star.select(F.col("node").alias("a"), "b"), "star")
        ends = star.select(F.col("a").alias("m")).union(star.select("b")).distinct()
        ends = stash(texts.join(ends.hint("merge"), F.col("node") == F.col("m"), "left_semi"), "texts")
        links = stash(_verified(star, ends, size, similarity), "links")
        known = components(links).select(F.col("node").alias("m"), "root")
        grouped = nodes.join(known.hint("merge"), F.col("node") == F.col("m"), "left").select("node", "size", "fp", F.coalesce("root", "node").alias("known"))
    found = _families(stash(_tree_groups(_dealt(_projected(grouped, bits), large, parts)), "found"))
    chunks = stash(found.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("chunks")), "chunks")
    live = spread_join(found, chunks, ["group"], "n").withColumnRenamed("__right_chunks", "chunks")
    live = live.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # A part of a large group meets itself in its pairs with the others.
    live = live.where("chunks = 1 or chunk <> other").select("node", "known", F.xxhash64("group", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"))
    near = texts.withColumnRenamed("node", "m").hint("merge")
    dealt = live.join(near, F.col("node") == F.col("m")).select("key", "node", "known", "text")
    more = _group_links(dealt.repartition(parts, "key").sortWithinPartitions("key"), size, similarity)
    roots = components(links.union(more) if links else more).select(F.col("node").alias("m"), "root")
    return named.join(roots, F.col("node") == F.col("m"), "left").select("row", F.coalesce("root", "node").alias("root"))


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row of docs: the groups of similar_rows, named by their smallest id.

    Defined cases: null text counts as empty; texts without words are alike, and like no other; rows with a null id take
    part as rows of their own and count as the smallest id; repeated rows stay repeated; an empty table gives an empty
    result; other columns of docs are ignored.
    """
    rows = numbered(docs.select(id_col, text_col))
    found = rows.select(F.col(ROW).alias("r"), F.col(id_col).alias("doc_id")).join(stash(similar_rows(rows, size, similarity, text_col=text_col), "roots"), F.col("r") == F.col("row"))
    lowest = F.lit(-(2**63))
    least = found.groupBy("root").agg(F.min(F.coalesce("doc_id", lowest)).alias("component_id")).withColumnRenamed("root", "g")
    return found.join(least, F.col("root") == F.col("g")).select("doc_id", F.when(F.col("component_id") != lowest, F.col("component_id")).alias("component_id"))


def near_duplicate_groups(docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", fps: DataFrame | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Defined cases: null text counts as empty; texts without words have fingerprint zero and link like any other; rows
    with a null id take part as the smallest id; repeated rows stay repeated; an empty table gives an empty result;
    other columns of docs are ignored.
    """
    ship(docs.sparkSession)
    fps = stash(fingerprints(docs, size, id_col, text_col) if fps is None else fps, "fingerprints")
    nodes = stash(fps.groupBy("fp").agg(F.min(F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).alias("node")), "nodes")
    # Two fingerprints never share a smallest id unless ids repeat; then the shared id joins them, as one document has both texts.
    roots = components(hamming_edges(nodes, radius))
    named = nodes.join(roots, "node", "left").select(F.col("fp").alias("f"), F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("f")).select(
        "doc_id", "fp", F.when(F.col("component_id") != -(2**63), F.col("component_id")).alias("component_id")
    )


def hex64(col) -> F.Column:
    return F.lower(F.lpad(F.hex(col), 16, "0"))
