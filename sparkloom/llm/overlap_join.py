"""Exact self-join of texts by the Jaccard similarity of their word shingles, as T-occurrence searches in inverted lists.

Texts of equal shingle sets are one node. Which nodes meet: shingles get one order for all texts, by how many documents share the
shingle's slot of a table of 2**SLOT_BITS counts over all documents, then by hash. Two sets that are alike enough share a shingle among the first
(least common) of each, so every node is posted under these; nodes of one posting list become candidates of each other if neither their
sizes nor the parity bitmaps of their sets, which differ in at most as many bits as the sets do, rule it out. Connected
candidates are a family, and every pair that can link is inside one.

What links: in each family, an inverted index of the members' shingles answers one T-occurrence query for each member: which earlier members are in at least T of its
lists? By DivideSkip, the L longest lists are set aside, the short ones are merged by id (their sorted runs, counted), who is in T - L of
them is looked up in the long lists by binary search until T is reached or out of reach, and the exact overlap decides. Pairs that earlier links
have joined are not looked up.

A family beyond GROUP_ROWS members or GROUP_SHINGLES shingles is dealt to parts, each with the family's smallest node, which joins
families of near copies by one link a node; then only members outside the family's largest group meet the other parts, in pairs of parts. So
no group is gathered in one task, whatever its size, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ROW, map_arrow, numbered, ship, spread_join, stash, text_slices, unstash, utf8_buffers
from .simhash import _dealt, _distance, _joined, _often, _parts, _shards, components
from .words import NON_SPACE_BYTES, hashes, mix, shingle_hashes, spans

SIZE, PERCENT = 5, 80
SLOT_BITS = 20
#: Least and greatest bits of a parity bitmap; between them a set has as many as it has members, to the next power of two.
BITMAP, BITMAP_MOST = 2048, 1 << 16
#: Bytes of bitmaps that are compared at once.
_COMPARED = 1 << 24
#: Nodes of one posting list that meet in a task, and members and shingles of a part of a family.
LIST_ROWS, GROUP_ROWS, GROUP_SHINGLES = 512, 512, 200_000
#: Weight of a probe against a merge step, as DivideSkip's authors fit it.
MU = 0.0085
#: Rows of lists that are merged at once, and pairs that are compared at once.
_MERGED, _PAIRS = 1_000_000, 65_536
#: Bytes of text of several shards that are searched at once.
_HELD_TEXT = 1_000_000
#: Members of families whose row keys are broadcast (16 MB), so that only their texts are shuffled; where there are more, all texts are.
BROADCAST_MEMBERS = 2_000_000
_UPPER = np.array([0x41 <= i <= 0x5A for i in range(256)])


def shingles(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle, with repeats. A text of fewer words is one shingle."""
    data, offsets = utf8_buffers(texts)
    data = np.where(_UPPER[data], data | 0x20, data)
    at, to, text = spans(data, offsets, NON_SPACE_BYTES)
    word = hashes(data, at, to)
    count = np.bincount(text, minlength=len(texts))
    h, first = shingle_hashes(word, text, size)
    owner, found = [text[first]], [h]
    for n in range(1, size):
        few = count[text] == n
        if few.any():
            h, first = shingle_hashes(word[few], text[few], n)
            owner.append(text[few][first])
            found.append(h)
    return np.concatenate(owner), np.concatenate(found)


def _stars(node: np.ndarray, known: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its group) of the nodes that pairs, or a known group, join with a smaller one."""
    root = _joined(known, pairs)[0]
    head = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(head, root, node)
    joined = head[root] != node
    return node[joined], head[root][joined]


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set with any set that is alike enough."""
    return -(-percent * size // 100)


def needed_of(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of sizes x and y that are alike enough."""
    return -(-percent * (x + y) // (100 + percent))


def bitmap_bits(size: np.ndarray) -> np.ndarray:
    return np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), BITMAP, BITMAP_MOST)


def apart(bitmaps: list[bytes], size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of x and y differ, at the lesser width of the two: the halves of a wider one are added up bit by bit."""
    wide = bitmap_bits(size)
    least = np.minimum(wide[x], wide[y])
    out = np.zeros(len(x), np.int64)
    for w in np.unique(least).tolist():
        of = np.flatnonzero(least == w)
        need = np.unique(np.concatenate((x[of], y[of])))
        place = np.zeros(len(size), np.int64)
        place[need] = np.arange(len(need))
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(bitmaps[i], np.uint64).reshape(-1, w // 64), axis=0) for i in need.tolist()])
        for at in range(0, len(of), max(1, _COMPARED * 8 // w)):
            some = of[at : at + max(1, _COMPARED * 8 // w)]
            out[some] = _distance(folded[place[x[some]]], folded[place[y[some]]])
    return out


def slot_counts(docs: DataFrame, size: int, text_col: str) -> np.ndarray:
    """How many shingles of all documents, each counted once a document, fall in each slot: 2**SLOT_BITS numbers, whatever the table's size."""
    width = 1 << 14
    kinds = "block int, lot int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for part in text_slices(batch, text_col):
                owner, h = shingles(part.column(0), size)
                order = np.lexsort((h, owner))
                owner, h = owner[order], h[order]
                new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
                total += np.bincount(_slots(h[new]), minlength=1 << SLOT_BITS)
        blocks = total.reshape(-1, width)
        yield {"block": range(len(blocks)), "lot": [TaskContext.get().partitionId() % 32] * len(blocks), "counts": [b.tobytes() for b in blocks]}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.int64)
        yield {"block": list(sums), "lot": [0] * len(sums), "counts": [s.tobytes() for s in sums.values()]}

    first = map_arrow(docs, count, kinds, [text_col]).repartition("block", "lot")
    second = map_arrow(first, add, kinds, ["block", "lot", "counts"]).repartition("block")
    out = np.zeros((1 << SLOT_BITS) // width * width, np.int64).reshape(-1, width)
    for block, _, counts in map_arrow(second, add, kinds, ["block", "lot", "counts"]).collect():
        out[block] += np.frombuffer(counts, np.int64)
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


def sketches(rows: DataFrame, size: int, percent: int, text_col: str) -> DataFrame:
    """(row, d0, d1, size, first, bitmap): digests and size of the set, its first shingles in the common order, and the parity of each bit that its shingles choose."""
    counts = rows.sparkSession.sparkContext.broadcast(slot_counts(rows, size, text_col))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        often = counts.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                for part in text_slices(batch.slice(start, 1024), text_col):
                    owner, h = shingles(part.column(1), size)
                    order = np.lexsort((h, often[_slots(h)], owner))
                    owner, h = owner[order], h[order]
                    if len(h):
                        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])))
                        owner, h = owner[new], h[new]
                    n = np.bincount(owner, minlength=part.num_rows)
                    sums = []
                    with np.errstate(over="ignore"):
                        for k in (1, 2):
                            total = np.zeros(part.num_rows, np.uint64)
                            np.add.at(total, owner, mix(h + np.uint64(k)))
                            sums.append(total.view(np.int64))
                    ends = np.cumsum(n)
                    begin = ends - n
                    many = n - needed(n, percent) + (n > 0)
                    raw = h.tobytes()
                    wide = bitmap_bits(n)
                    base = np.cumsum(wide) - wide
                    parity = np.bincount(base[owner] + (h & (wide[owner] - 1).astype(np.uint64)).astype(np.int64), minlength=int(wide.sum())) & 1
                    bits = np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()
                    yield {
                        "row": part.column(0), "d0": sums[0], "d1": sums[1], "size": n, "first": pa.array([raw[8 * a : 8 * (a + m)] for a, m in zip(begin.tolist(), many.tolist())], pa.binary()),
                        "bitmap": pa.array([bits[a // 8 : (a + w) // 8] for a, w in zip(base.tolist(), wide.tolist())], pa.binary()),
                    }

    return stash(map_arrow(rows, step, "row bigint, d0 bigint, d1 bigint, size bigint, first binary, bitmap binary", [ROW, text_col]), "sketches")


def _posted(nodes: DataFrame) -> DataFrame:
    """(key, node): each node under its first shingles."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = part.column(1).to_pylist()
                yield {"key": np.frombuffer(b"".join(raw), np.int64), "node": np.repeat(part.column(0).to_numpy(), [len(x) // 8 for x in raw])}

    return map_arrow(nodes, step, "key bigint, node bigint", ["node", "first"])


def _lists(dealt: DataFrame) -> DataFrame:
    """(list, node, side), distinct, of the posting lists with several nodes; lists of the same nodes are one."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for held in _shards(batches, ("key", "node", "side")):
            node, side = (np.concatenate([g[n] for g in held]) for n in ("node", "side"))
            size = np.array([len(g["node"]) for g in held])
            with np.errstate(over="ignore"):
                name = np.add.reduceat(mix(node.view(np.uint64) * np.uint64(4) + side.astype(np.uint64) + np.uint64(1)), np.cumsum(size) - size)
            yield {"list": np.repeat(name, size).view(np.int64), "node": node, "side": side.astype(np.int32)}

    return map_arrow(dealt, step, "list bigint, node bigint, side int", ["key", "node", "side"]).distinct()


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node of a list with the smallest one that the list's candidate pairs join it with. met: key (the list), node, side, size, bitmap, sorted by key."""

    def pairs(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of all i < j of each list."""
        last = np.repeat(start + size, size)
        i = np.arange(len(last))
        left = last - 1 - i
        cuts = np.searchsorted(np.cumsum(left), np.arange(_PAIRS, int(left.sum()) + _PAIRS, _PAIRS), side="left") + 1
        for a, b in zip(np.concatenate(([0], cuts[:-1])), cuts):
            n = left[a:b]
            x = np.repeat(i[a:b], n)
            yield x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for held in _shards(batches, ("key", "node", "side", "size", "bitmap")):
            size = np.array([len(g["node"]) for g in held])
            node, side, n, raw = (np.concatenate([g[k] for g in held]) for k in ("node", "side", "size", "bitmap"))

            def close() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for x, y in pairs(np.cumsum(size) - size, size):
                    fit = (side[x] == 0) | (side[x] != side[y])
                    fit &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
                    x, y = x[fit], y[fit]
                    fit = apart(raw, n, x, y) <= n[x] + n[y] - 2 * needed_of(n[x], n[y], percent)
                    yield x[fit], y[fit]

            _, known = np.unique(node, return_inverse=True)
            a, b = _stars(node, known, close())
            if len(a):
                yield {"a": a, "b": b}

    return map_arrow(met, joined, "a bigint, b bigint", ["key", "node", "side", "size", "bitmap"]).distinct()


def occurrences(owner: np.ndarray, value: np.ndarray, size: np.ndarray, side: np.ndarray, known: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y) of a spanning forest of all pairs of sets that are alike enough, beyond those of one known group.

    owner, value: the members of each set 0, 1, ..., distinct and in order of owner. side: sets of side 0 meet those of side 0; sets of side 1, which
    come after them, those of side 2. Values that two shards share are taken for different by the caller.
    """
    many = len(size)
    value, column, held = np.unique(value, return_inverse=True, return_counts=True)
    some = held[column] > 1
    owner, column = owner[some], column[some]
    indexed = side[owner] != 1
    postings = np.sort(column[indexed] * many + owner[indexed])
    asks = side[owner] != 2
    query, column = owner[asks], column[asks]
    low = np.searchsorted(postings, column * many)
    length = np.searchsorted(postings, column * many + query) - low  # earlier sets only
    some = length > 0
    query, column, low, length = query[some], column[some], low[some], length[some]
    order = np.lexsort((-length, query))
    query, column, low, length = query[order], column[order], low[order], length[order]
    lists = np.bincount(query, minlength=many)
    first = np.cumsum(lists) - lists
    least = needed(size, percent)
    longest = np.zeros(many, np.int64)
    np.maximum.at(longest, query, length)
    aside = np.where(lists >= least, np.minimum(least - 1, (least / (MU * np.log2(np.maximum(longest, 1)) + 1)).astype(np.int64)), 0)
    place = np.arange(len(query)) - first[query]
    short = (place >= aside[query]) & (lists[query] >= least[query])
    merged = np.cumsum(np.where(short, length, 0))
    root = known
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def overlap(x: np.ndarray, y: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Which pairs are alike enough: their count in short lists, then binary probes of the long ones until T is reached or can't be."""
        goal = needed_of(size[x], size[y], percent)
        left = aside[x].copy()
        count = count.copy()
        live = np.flatnonzero((count < goal) & (left > 0))
        while len(live):
            step = np.minimum(left[live], 16)
            of = np.repeat(live, step)
            k = np.arange(len(of)) - np.repeat(np.cumsum(step) - step, step)
            at = first[x[of]] + left[of] - 1 - k  # the shorter of the long lists first
            key = column[at] * many + y[of]
            hit = postings[np.minimum(np.searchsorted(postings, key), len(postings) - 1)] == key
            count += np.bincount(of[hit], minlength=len(x))
            left[live] -= step
            live = live[(left[live] > 0) & (count[live] < goal[live]) & (count[live] + left[live] >= goal[live])]
        return count >= goal

    def join(x: np.ndarray, y: np.ndarray, count: np.ndarray) -> None:
        nonlocal root
        ok = overlap(x, y, count)
        root, a, b = _joined(root, iter([(x[ok], y[ok])]))
        kept.append((a, b))

    begin = 0
    while begin < len(query):
        # Whole queries, of about _MERGED rows of short lists.
        done = merged[begin - 1] if begin else 0
        end = int(np.searchsorted(merged, done + _MERGED, side="right"))
        end = len(query) if end >= len(query) else max(int(first[query[end]]), int(first[query[begin]] + lists[query[begin]]))
        part = begin + np.flatnonzero(short[begin:end])
        of = np.repeat(part, length[part])
        y = postings[low[of] + np.arange(len(of)) - np.repeat(np.cumsum(length[part]) - length[part], length[part])] - column[of] * many
        cell, count = np.unique(query[of] * many + y, return_counts=True)
        x, y = cell // many, cell % many
        fit = (count >= least[x] - aside[x]) & (count + aside[x] >= needed_of(size[x], size[y], percent)) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
        x, y, count = x[fit], y[fit], count[fit]
        # The first candidate of each query, then of each other set, join most of a group; the others follow in blocks.
        for other in (False, True):
            new = np.zeros(len(x), bool)
            new[np.unique(y if other else x, return_index=True)[1]] = True
            join(x[new], y[new], count[new])
            apart = ~new & (root[x] != root[y])
            x, y, count = x[apart], y[apart], count[apart]
        for at in range(0, len(x), _PAIRS):
            a, b, n = (v[at : at + _PAIRS] for v in (x, y, count))
            apart = root[a] != root[b]
            join(a[apart], b[apart], n[apart])
        begin = end
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(a for a, _ in kept)]), np.concatenate([none, *(b for _, b in kept)])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Shards of two rows or more, one after the other; rows come sorted by key."""
    names = ("key", "side", "node", "known", "wide", "text")
    rest: list[dict] = []
    for batch in batches:
        for part in text_slices(batch, "text"):
            cols = {n: part.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
            cuts = [0, *(np.flatnonzero(cols["key"][1:] != cols["key"][:-1]) + 1).tolist(), part.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if rest and rest[0]["key"][0] != cols["key"][a]:
                    if sum(len(r["key"]) for r in rest) > 1:
                        yield {n: np.concatenate([r[n] for r in rest]) for n in names}
                    rest = []
                if b > a:
                    rest.append({n: v[a:b] for n, v in cols.items()})
    if sum(len(r["key"]) for r in rest) > 1:
        yield {n: np.concatenate([r[n] for r in rest]) for n in names}


def _texts_of(members: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """(m, text) of the rows that members (node) name; others may follow where they are too many to broadcast."""
    texts = rows.select(F.col(ROW).alias("m"), F.coalesce(text_col, F.lit("")).alias("text"))
    if members.count() > BROADCAST_MEMBERS:
        return texts
    wanted = rows.sparkSession.sparkContext.broadcast(np.sort(members.select("node").toArrow().column(0).to_numpy()))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        nodes = wanted.value
        for batch in batches:
            m = batch.column(0).to_numpy()
            place = np.minimum(np.searchsorted(nodes, m), max(len(nodes) - 1, 0))
            kept = batch.filter(pa.array(nodes[place] == m if len(nodes) else np.zeros(len(m), bool)))
            yield {"m": kept.column(0), "text": kept.column(1)}

    return map_arrow(texts, step, "m bigint, text string", ["m", "text"])


def _linked(dealt: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, wide): each node of a shard with the smallest one that links in it, and known groups, join it with. dealt: key, side, node, known, wide, text, sorted by key."""

    def search(held: list[dict]) -> dict | None:
        node, known, wide, side, text = (np.concatenate([g[k] for g in held]) for k in ("node", "known", "wide", "side", "text"))
        shard = np.repeat(np.arange(len(held)), [len(g["node"]) for g in held])
        order = np.lexsort((-side, shard))  # side 2 before side 1
        node, known, wide, side, text, shard = (v[order] for v in (node, known, wide, side, text, shard))
        owner, h = shingles(pa.array(text, pa.large_string()), size)
        cell = np.lexsort((h, owner))
        owner, h = owner[cell], h[cell]
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
        owner, h = owner[new], h[new]
        with np.errstate(over="ignore"):
            value = mix(h ^ mix(shard[owner].astype(np.uint64) + np.uint64(1)))
        _, group = np.unique(known, return_inverse=True)
        x, y = occurrences(owner, value, np.bincount(owner, minlength=len(node)), side, group, percent)
        if not len(x):
            return None
        # A node that is in several shards joins them, as it would later.
        a, b = _stars(node, group, iter([(x, y)]))
        broad = np.isin(a, node[wide])
        return {"a": a, "b": b, "wide": broad}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        waiting, size_now = [], 0
        for shard in _whole(batches):
            waiting.append(shard)
            size_now += sum(map(len, shard["text"]))
            if size_now > _HELD_TEXT:
                if (out := search(waiting)) is not None:
                    yield out
                waiting, size_now = [], 0
        if waiting and (out := search(waiting)) is not None:
            yield out

    return map_arrow(dealt, step, "a bigint, b bigint, wide boolean", ["key", "side", "node", "known", "wide", "text"]).distinct()


def similar_nodes(nodes: DataFrame, rows: DataFrame, size: int, percent: int, text_col: str) -> DataFrame:
    """(node, root) of the nodes that have links: the smallest node that they reach. nodes: node, size, first, bitmap, written; rows: the texts by row."""
    spark = nodes.sparkSession
    keyed = _posted(nodes)
    parts = _parts(spark, nodes.agg(F.coalesce(F.sum(F.length("first")) / 8, F.lit(0)).cast("bigint")).first()[0])
    large = stash(_often(keyed.select("key")).where(F.col("n") > LIST_ROWS).select(F.col("key").alias("large"), F.ceil(F.col("n") / LIST_ROWS).cast("int").alias("chunks")), "large")
    lists = stash(_lists(_dealt(keyed, large, parts)), "lists")
    met = lists.join(nodes.select(F.col("node").alias("m"), "size", "bitmap").hint("merge"), F.col("node") == F.col("m"))
    met = met.select(F.col("list").alias("key"), "node", "side", "size", "bitmap").repartition(parts, "key").sortWithinPartitions("key")
    family = components(_candidates(met, percent)).select("node", F.col("root").alias("family"))
    own = F.col("node") == F.col("m")
    members = family.union(family.select("family", "family").distinct()).distinct()
    members = stash(members.join(nodes.select(F.col("node").alias("m"), "size").hint("merge"), own).drop("m"), "members")
    extent = stash(members.groupBy(F.col("family").alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all")), "families")
    chunks = F.ceil(F.greatest(F.col("n") / GROUP_ROWS, F.col("all") / GROUP_SHINGLES)).cast("int")
    extent = extent.select(F.col("f").alias("family"), "n", chunks.alias("chunks"))
    texts = _texts_of(members, rows, text_col)
    placed = spread_join(members, extent, ["family"], "n").select("node", "family", F.col("__right_chunks").alias("chunks"))
    placed = stash(placed.join(texts.hint("merge"), own).drop("m"), "texts")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    # The family's smallest node is in all parts.
    first = placed.withColumn("part", F.explode(F.when(F.col("node") == F.col("family"), every).otherwise(F.array(chunk))))
    first = first.select(F.xxhash64("family", "part").alias("key"), F.lit(0).alias("side"), "node", F.col("node").alias("known"), (F.col("chunks") > 1).alias("wide"), "text")
    links = stash(_linked(first.repartition(parts, "key").sortWithinPartitions("key"), size, percent), "links")
    # A family in one part is done; those in several go on.
    done = links.where("not wide").select(F.col("a").alias("node"), F.col("b").alias("root"))
    wide = placed.where("chunks > 1")
    if wide.isEmpty():
        return done
    found = links.where("wide").select("a", "b")
    return done.union(components(found.union(_rest(wide, found, size, percent, parts).select("a", "b"))))


def _rest(wide: DataFrame, links: DataFrame, size: int, percent: int, parts: int) -> DataFrame:
    """Links between the parts of large families, but for pairs within a family's largest group so far. wide: node, family, chunks, text; links: each node with the smallest of its part's group."""
    roots = links.select(F.col("a").alias("m"), F.col("b").alias("root"))
    known = stash(wide.select("node", "family").join(roots.hint("merge"), F.col("node") == F.col("m"), "left").select("node", "family", F.coalesce("root", "node").alias("known")), "known")
    groups = known.groupBy("family", "known").agg(F.count(F.lit(1)).alias("n"))
    top = groups.groupBy(F.col("family").alias("f")).agg(F.max_by("known", F.struct("n", "known")).alias("top"), F.sum("n").alias("all"), F.max("n").alias("most"))
    top = stash(top.where("all > most"), "tops")  # the others are joined as a whole
    at = wide.join(known.select(F.col("node").alias("m"), "known").hint("merge"), F.col("node") == F.col("m")).drop("m")
    at = spread_join(stash(at, "wide"), top.withColumnRenamed("f", "family"), ["family"], "all")
    within = F.col("known") == F.col("__right_top")
    share = lambda n: F.greatest(F.lit(1), F.ceil(F.col("chunks") * n / F.col("__right_all"))).cast("int")
    at = at.withColumn("settled", share(F.col("__right_most"))).withColumn("others", share(F.col("__right_all") - F.col("__right_most")))
    lot = F.xxhash64("node")
    at = at.withColumn("part", F.when(within, F.pmod(lot, F.col("settled"))).otherwise(F.col("settled") + F.pmod(lot, F.col("others"))).cast("int"))
    # A settled part meets each part of the others; a part of the others meets all parts.
    meets = F.when(within, F.sequence(F.col("settled"), F.col("settled") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("settled") + F.col("others") - 1))
    at = at.withColumn("other", F.explode(meets))
    key = F.xxhash64("family", F.least("part", "other"), F.greatest("part", "other"))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    dealt = at.select(key.alias("key"), side.alias("side"), "node", "known", F.lit(True).alias("wide"), "text").repartition(parts, "key").sortWithinPartitions("key")
    return _linked(dealt, size, percent)


def join_similar(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: the size of its set of word shingles, and the smallest id that it reaches over links.

    Two texts link when 100 times the intersection of their sets is at least percent times the union. Words are runs of what isn't ASCII white space, A-Z
    lower-cased. Sets are compared by 64-bit hashes of their members.

    Defined cases: a text with fewer words than size is one shingle; null, empty and wordless texts have the empty set and link with nothing; rows with a null id
    take part as rows of their own and count as the smallest id, so their component's id is null; repeated rows and rows that share an id are
    told apart, and link by their texts; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col)))
    found = sketches(rows, size, percent, text_col)
    heads = stash(found.where("size > 0").groupBy("d0", "d1").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")), "heads")
    named = stash(spread_join(found, heads, ["d0", "d1"], "n").withColumnRenamed("__right_node", "node").select("row", "node", "size", *[F.when(F.col("row") == F.col("node"), F.col(c)).alias(c) for c in ("first", "bitmap")]), "nodes")
    unstash(found)
    roots = similar_nodes(named.where("row = node").select("node", "size", "first", "bitmap"), rows, size, percent, text_col)
    roots = roots.select(F.col("node").alias("m"), "root")
    of = named.select("row", "node", "size").join(roots.hint("merge"), F.col("node") == F.col("m"), "left").select(F.col("row").alias("r"), "size", F.coalesce("root", "node").alias("root"))
    lowest = F.lit(-(2**63))
    ids = rows.select(F.col(ROW).alias("row"), "id").join(of.hint("merge"), F.col("row") == F.col("r"), "left")  # those without words are in no node
    ids = stash(ids.select("row", "id", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), F.coalesce("root", "row").alias("root")), "roots")
    least = stash(ids.groupBy("root").agg(F.min(F.coalesce("id", lowest)).alias("least"), F.count(F.lit(1)).alias("n")), "least")
    out = spread_join(ids, least, ["root"], "n")
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("__right_least") != lowest, F.col("__right_least")).alias("component_id"))


def oracle_sql() -> str:
    """DuckDB SQL of op11 at its production parameters."""
    return """
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), sizes AS (SELECT r, doc_id, len(s)::BIGINT AS n_shingles FROM sets),
members AS (SELECT r, unnest(s) AS shingle FROM sets),
shared AS (SELECT x.r AS a, y.r AS b, count(*) AS n FROM members x JOIN members y ON x.shingle = y.shingle AND x.r <> y.r GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * n >= 80 * (x.n_shingles + y.n_shingles - n)),
reach(a, b) AS (SELECT r, r FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT x.doc_id, any_value(x.n_shingles) AS n_shingles, min(y.doc_id) AS component_id FROM reach JOIN sizes x ON x.r = reach.a JOIN sizes y ON y.r = reach.b GROUP BY x.r, x.doc_id
"""
