"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact shingle similarity.

Texts are lower-cased words (runs of letters and digits). An item is the multiset of its five-word shingles; shorter
items are one shingle, their whole sequence. A window of a document has as many words as the item. Its SimHash (64
bits) is looked up in a multi-index: eight blocks of eight bits, of which one at least differs in no more than radius // 8
bits for every fingerprint within the radius, so none is lost. Each hit is verified by the exact weighted (multiset)
Jaccard similarity of the shingles, ``threshold`` or more.

A window can only reach the threshold with enough shingles that belong to items: 2 t / (1 + t) of its own. Windows
with fewer are skipped before their SimHash is built; that loses nothing, as verification would reject them.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from ._common import map_arrow, ship, text_slices, utf8_buffers

SHINGLE = 5
THRESHOLD = 0.8
#: Differing bits of two fingerprints. At similarity 0.8 about 10 of 64 differ, with a deviation of 3.
RADIUS = 22
#: Characters of items whose index is built and broadcast at once; more items are searched in blocks of this size.
BLOCK_CHARS = 4_000_000
_FILTER_BITS = 20


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash, text, place) of each shingle, and words per text. A text of fewer words has one shingle."""
    data, offsets = utf8_buffers(pc.utf8_lower(texts))
    at, to, text = W.spans(data, offsets, W.WORD_BYTES)
    word = W.hashes(data, at, to)
    counts = np.bincount(text, minlength=len(texts))
    first = np.cumsum(counts) - counts
    h, where = W.shingle_hashes(word, text, size)
    owner = text[where]
    place = where - first[owner]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = []
        for i in short:
            x = np.uint64(counts[i])
            with np.errstate(over="ignore"):
                for w in word[first[i] : first[i] + counts[i]]:
                    x = x * np.uint64(0xD6E8FEB86659FD93) + w
            extra.append(x)
        h = np.concatenate((h, W.mix(np.array(extra, np.uint64))))
        owner, place = np.concatenate((owner, short)), np.concatenate((place, np.zeros(len(short), np.int64)))
        order = np.lexsort((place, owner))
        h, owner, place = h[order], owner[order], place[order]
    return h, owner, place, counts


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)


def simhash(bit_sums: np.ndarray, size: int) -> np.ndarray:
    return np.packbits(bit_sums * 2 > size, axis=-1, bitorder="little").view(np.uint64)[..., 0]


class HammingIndex:
    """Multi-index: for each block of eight bits, the fingerprints by the block's value."""

    def __init__(self, fps: list[int], radius: int):
        self.fps, self.radius = fps, radius
        near = radius // 8
        self.flips = [sum(1 << b for b in c) for n in range(near + 1) for c in itertools.combinations(range(8), n)]
        self.tables: list[dict[int, list[int]]] = [{} for _ in range(8)]
        for i, fp in enumerate(fps):
            for k in range(8):
                self.tables[k].setdefault(fp >> 8 * k & 255, []).append(i)

    def within(self, fp: int) -> list[int]:
        found = set()
        for k, block in enumerate(self.tables):
            value = fp >> 8 * k & 255
            for flip in self.flips:
                found.update(block.get(value ^ flip, ()))
        return sorted(i for i in found if (self.fps[i] ^ fp).bit_count() <= self.radius)


class Items:
    """The items of one block, ready for search."""

    def __init__(self, ids: list, texts: list[str], threshold: float, radius: int, size: int = SHINGLE):
        self.threshold, self.size = threshold, size
        h, owner, _, counts = shingles(pa.array(texts, pa.large_string()), size)
        self.ids, self.words, self.bags, fps, self.by_length = [], [], [], [], {}
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            own = h[cuts[i] : cuts[i + 1]]
            if len(own):
                self.by_length.setdefault(int(counts[i]), []).append(len(self.ids))
                self.ids.append(ids[i])
                self.words.append(int(counts[i]))
                self.bags.append(Counter(own.tolist()))
                fps.append(int(simhash(_bits(own).sum(axis=0), len(own))))
        self.index = HammingIndex(fps, radius)
        self.known = np.unique(h)
        self.lengths_of: dict[int, set[int]] = {}
        for n, bag in zip(self.words, self.bags):
            for s in bag:
                self.lengths_of.setdefault(s, set()).add(n)
        self.short = sorted({n for n in self.words if n < size})
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def search(self, h: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the verified windows of one text with shingles h."""
        total = np.concatenate(([0], np.cumsum(hit)))
        lengths = set().union(*(self.lengths_of[s] for s in np.unique(h[hit]).tolist()))
        least = 2 * self.threshold / (1 + self.threshold)
        for n in sorted(lengths):
            m = n - self.size + 1
            if m < 1 or m > len(h):
                # a text shorter than the item is one window
                m = len(h)
            inside = total[m:] - total[:-m]
            starts = np.flatnonzero(inside >= math.ceil(least * m - 1e-9))
            if not len(starts):
                continue
            for some in np.split(starts, np.flatnonzero(np.diff(starts) > m) + 1):
                lo = int(some[0])
                sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(h[lo : int(some[-1]) + m]), axis=0, dtype=np.int32)))
                fps = simhash(sums[some - lo + m] - sums[some - lo], m)
                for s, fp in zip(some.tolist(), fps.tolist()):
                    near = [i for i in self.index.within(fp) if self.words[i] == n]
                    if near:
                        bag = Counter(h[s : s + m].tolist())
                        for i in near:
                            shared = sum(min(c, bag[x]) for x, c in self.bags[i].items() if x in bag)
                            alike = shared / (m + sum(self.bags[i].values()) - shared)
                            if alike >= self.threshold - 1e-12:
                                yield i, s, n, alike


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the best window of each document for each item it contains.

    Defined cases: null or wordless texts and items match nothing; repeated rows and items are reported each; ties go
    to the earliest window; empty tables give an empty result; other columns are ignored. Items are held in blocks of
    block_chars characters at most (or one item), each searched over all documents.
    """
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word int, n_words int, similarity double"
    out = None
    for shared in _blocks(benchmark, threshold, radius, item_col, item_text, block_chars):
        found = _search(docs, shared, schema, id_col, text_col)
        out = found if out is None else out.union(found)
    return out


def _blocks(benchmark: DataFrame, threshold: float, radius: int, item_col: str, item_text: str, block_chars: int) -> Iterator[Broadcast]:
    """The indexes of the items, by blocks of about block_chars characters; one at least."""
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("item_text")).where("item_text is not null")
    chars = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(chars / block_chars))
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_text"), F.lit(n_blocks)) == block).collect()
        yield spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], threshold, radius))


def _search(docs: DataFrame, shared, schema: str, id_col: str, text_col: str) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        items = shared.value
        for batch in batches:
            for part in text_slices(batch, text_col):
                found = [x for x in _scan(items, part.column(1))]
                if found:
                    ids = part.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                    yield {
                        "doc_id": ids, "item_id": pa.array([items.ids[x[1]] for x in found]), "start_word": pa.array([x[2] for x in found], pa.int32()),
                        "n_words": pa.array([x[3] for x in found], pa.int32()), "similarity": pa.array([x[4] for x in found], pa.float64()),
                    }

    return map_arrow(docs, step, schema, [id_col, text_col])


def _scan(items: Items, texts: pa.Array) -> Iterator[tuple[int, int, int, int, float]]:
    if not len(items.known):
        return
    h, owner, _, _ = shingles(texts, items.size)
    maybe = np.flatnonzero(items.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    sure = maybe[items.known[np.minimum(np.searchsorted(items.known, h[maybe]), len(items.known) - 1)] == h[maybe]]
    found: list[tuple[int, int, int, int, float]] = []
    for text in np.unique(owner[sure]).tolist():
        a, b = np.searchsorted(owner, [text, text + 1])
        hit = np.zeros(b - a, bool)
        hit[sure[(sure >= a) & (sure < b)] - a] = True
        best: dict[int, tuple[float, int, int]] = {}
        for i, s, n, alike in items.search(h[a:b], hit):
            if i not in best or alike > best[i][0]:
                best[i] = (alike, s, n)
        found += [(text, i, s, n, alike) for i, (alike, s, n) in sorted(best.items())]
    if items.short:
        found += _short(items, texts)
    yield from found


def _short(items: Items, texts: pa.Array) -> Iterator[tuple[int, int, int, int, float]]:
    """Items of fewer words than a shingle: their exact word sequence."""
    data, offsets = utf8_buffers(pc.utf8_lower(texts))
    at, to, text = W.spans(data, offsets, W.WORD_BYTES)
    word = W.hashes(data, at, to)
    counts = np.bincount(text, minlength=len(texts))
    first = np.cumsum(counts) - counts
    for n in items.short:
        k = len(word) - n + 1
        if k <= 0:
            continue
        x = np.full(k, n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                x = x * np.uint64(0xD6E8FEB86659FD93) + word[j : j + k]
        x = W.mix(x)
        x[text[:k] != text[n - 1 : n - 1 + k]] = 0
        for i in items.by_length[n]:
            seen = set()
            for p in np.flatnonzero(x == np.uint64(next(iter(items.bags[i])))).tolist():
                t = int(text[p])
                if t not in seen and (counts[t] >= items.size or counts[t] != n):
                    seen.add(t)
                    yield t, i, int(p - first[t]), n, 1.0


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, item_col: str = "item_id",
               item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found.

    Each row is judged by its own text where it is read, whatever its id; nothing is shuffled. Each block of items is searched in what the
    blocks before it have kept.
    """
    where = docs.columns.index(text_col)
    schema = docs.schema
    for shared in _blocks(benchmark, threshold, radius, item_col, item_text, block_chars):
        docs = docs.mapInArrow(_clean(shared, where), schema)
    return docs


def _clean(shared: Broadcast, where: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for part in text_slices(batch, batch.schema.names[where]):
                clean = np.ones(part.num_rows, bool)
                clean[[x[0] for x in _scan(items, part.column(where))]] = False
                yield part.filter(pa.array(clean))

    return step
