"""I-Match fingerprints: mid-frequency terms, several randomised lexicon subsets, one hash each.

A term is a lower-cased word. Its inverse document frequency is ln(N / df) over all documents; the lexicon holds the
terms inside [idf_low, idf_high]. As df >= N / exp(idf_high) for each of them, the lexicon has at most exp(idf_high) times the
mean number of distinct terms of a document, whatever N is; that bounds what is broadcast. A text keeps its distinct lexicon
terms in order; a text with fewer than FEW keeps all its terms. Randomised subsets of the lexicon come in four levels: SUBSETS
subsets a level, each with 1/32, 1/128, 1/512 or 1/2048 of the terms. A subset's hash covers the sorted distinct
terms that the text has in it; the fingerprint lists all hashes, 16 bits each, 0 where there is none.

The likeness of two fingerprints is the share of equal hashes among the subsets that either text has terms in, at the densest
level where those are at most 7 of 10: there a subset holds about one term, so it is near the share of common terms.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from ._common import map_arrow, ship, stash, text_slices, utf8_buffers

IDF_LOW, IDF_HIGH = 2.0, 7.6
LEVELS = (32, 128, 512, 2048)
SUBSETS = 32
FEW = 4
_TERM_BITS = 44
_HELD = 2_000_000


def distinct_terms(texts: pa.Array) -> np.ndarray:
    """Sorted distinct (text << 44 | term) of a slice of texts; a term is a 44-bit word hash."""
    data, offsets = utf8_buffers(pc.utf8_lower(texts))
    at, to, text = W.spans(data, offsets, W.WORD_BYTES)
    return np.unique(text.astype(np.uint64) << np.uint64(_TERM_BITS) | W.hashes(data, at, to) >> np.uint64(64 - _TERM_BITS))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df) over all rows of docs; each task adds up what it has read before anything is shuffled."""

    def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        term, where = np.unique(np.concatenate(keys), return_inverse=True)
        return term, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            for part in text_slices(batch, text_col):
                term, n = np.unique(distinct_terms(part.column(0)) & np.uint64((1 << _TERM_BITS) - 1), return_counts=True)
                keys.append(term)
                counts.append(n)
                if sum(map(len, keys)) > _HELD:
                    term, n = merge(keys, counts)
                    keys, counts = [term], [n]
                    if len(term) > _HELD // 2:
                        yield {"term": term.view(np.int64), "n": n}
                        keys, counts = [], []
        if keys:
            term, n = merge(keys, counts)
            for i in range(0, len(term), 1 << 16):
                yield {"term": term.view(np.int64)[i : i + (1 << 16)], "n": n[i : i + (1 << 16)]}

    return map_arrow(docs, step, "term bigint, n bigint", [text_col]).groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", idf_low: float = IDF_LOW, idf_high: float = IDF_HIGH) -> np.ndarray:
    """Sorted terms inside the band."""
    n = docs.count()
    band = document_frequencies(docs, text_col).where(F.col("df").between(n * math.exp(-idf_high), n * math.exp(-idf_low)))
    got = band.select("term").toArrow().column(0).to_numpy()
    return np.sort(got.view(np.uint64))


def subset_hashes(texts: pa.Array, terms: np.ndarray) -> np.ndarray:
    """uint16 of shape (texts, levels, subsets)."""
    keys = distinct_terms(texts)
    text = (keys >> np.uint64(_TERM_BITS)).astype(np.int64)
    term = keys & np.uint64((1 << _TERM_BITS) - 1)
    if len(terms):
        inside = terms[np.minimum(np.searchsorted(terms, term), len(terms) - 1)] == term
    else:
        inside = np.zeros(len(term), bool)
    few = np.bincount(text[inside], minlength=len(texts)) < FEW
    inside |= few[text]
    text, term = text[inside], term[inside]
    sums = np.zeros(len(texts) * len(LEVELS) * SUBSETS, np.uint64)
    some = np.zeros(len(sums), bool)
    with np.errstate(over="ignore"):
        for k, parts in enumerate(LEVELS):
            lot = W.mix(term ^ np.uint64(0x1000000000000000 * (k + 1)))
            subset = (lot % np.uint64(parts)).astype(np.int64)
            own = subset < SUBSETS
            slot = (text[own] * len(LEVELS) + k) * SUBSETS + subset[own]
            # terms are sorted, so equal sets give equal sums
            np.add.at(sums, slot, W.mix(lot[own]))
            some[slot] = True
    out = (W.mix(sums) >> np.uint64(48)).astype(np.uint16)
    out[some & (out == 0)] = 1
    out[~some] = 0
    return out.reshape(len(texts), len(LEVELS), SUBSETS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of fingerprints of shape (n, levels, subsets), pairwise: 0 to 1. Two without any term are alike."""
    either = ((a != 0) | (b != 0)).sum(axis=2)
    equal = ((a == b) & (a != 0)).sum(axis=2)
    sparse = either <= 0.7 * SUBSETS
    level = np.where(sparse.any(axis=1), sparse.argmax(axis=1), len(LEVELS) - 1)
    at = np.arange(len(a))
    thin = (either[at, level] < 4) & (level > 0)
    level = np.where(thin, level - 1, level)
    n = either[at, level]
    share = equal[at, level] / np.maximum(n, 1)
    none = either.sum(axis=1) == 0
    total = equal.sum(axis=1) / np.maximum(either.sum(axis=1), 1)
    return np.where(none, 1.0, np.where(n == 0, total, share))


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 binary, own binary, edited binary, near_edited double, near_next double"
_EDGE = "k bigint, h bigint, u bigint, tail int, text string"


def _judged(rows: list[tuple], terms: np.ndarray) -> dict:
    """Result columns of rows (doc_id, text, fingerprint, text of the next, fingerprint of the next)."""
    edited = [t[: len(t) - len(t) // 4] + nxt[: len(t) // 4] for _, t, _, nxt, _ in rows]
    a, c = (np.array([r[i] for r in rows], np.uint16).reshape(len(rows), len(LEVELS), SUBSETS) for i in (2, 4))
    b = subset_hashes(pa.array(edited, pa.large_string()), terms)
    name = lambda x: x.astype(">u2").tobytes()
    return {
        "doc_id": pa.array([r[0] for r in rows], pa.int64()), "n_chars": pa.array([len(r[1]) for r in rows], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).digest() for e in edited], pa.binary()),
        "own": pa.array([name(x) for x in a], pa.binary()), "edited": pa.array([name(x) for x in b], pa.binary()),
        "near_edited": likeness(a, b), "near_next": likeness(a, c),
    }


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; see the module.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many of the next document in
    ascending doc_id (after the last: the first). Texts move once, to ranges of (id, hash of the text, row), so that an
    id or text of many rows fills several ranges; within a range each row meets its next one. Only the first and last
    row of each range are kept with their texts and meet those of the neighbouring ranges in a second, small step.

    Defined cases: null and wordless texts have the fingerprint of no terms; rows with
    one id follow each other by a hash of their text; a null id comes first; a lone row is its own next; an empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(lexicon(docs, text_col))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("t"))
    rows = rows.select("doc_id", "t", F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("u"))
    dealt = rows.repartitionByRange("k", "h", "u").sortWithinPartitions("k", "h", "u")
    ends = ("k", "h", "u", "tail", "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        terms = shared.value
        held = None  # the last row, which waits for its next: (doc_id, text, fingerprint), then its key
        for batch in batches:
            for part in text_slices(batch, "t", 1 << 19):
                own = subset_hashes(part.column(1), terms)
                key, text = part.column(0).to_pylist(), part.column(1).to_pylist()
                order = list(zip(*(part.column(i).to_pylist() for i in (2, 3, 4))))
                ready = [(key[i - 1], text[i - 1], own[i - 1], text[i], own[i]) for i in range(1, len(text))]
                if held is None:
                    yield _mixed([], [(*order[0], 0, text[0])], terms, key[0])
                else:
                    ready.insert(0, (*held[0], text[0], own[0]))
                if ready:
                    yield _mixed(ready, [], terms)
                held = (key[-1], text[-1], own[-1]), order[-1]
        if held is not None:
            yield _mixed([], [(*held[1], 1, held[0][1])], terms, held[0][0])

    def _mixed(ready: list[tuple], edges: list[tuple], terms: np.ndarray, key=None) -> dict:
        """Rows of the result, or one edge, with nulls in the other columns."""
        n = len(ready) or 1
        if ready:
            out = _judged(ready, terms)
            return out | {x: pa.nulls(n, pa.string() if x == "text" else pa.int32() if x == "tail" else pa.int64()) for x in ends}
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        out = dict(zip((f.split()[0] for f in _RESULT.split(", ")), (pa.nulls(1, t) for t in kinds)))
        out["doc_id"] = pa.array([key], pa.int64())
        return out | dict(zip(ends, (pa.array([x], t) for x, t in zip(edges[0], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())))))

    found = stash(map_arrow(dealt, step, f"{_RESULT}, {_EDGE}", ["doc_id", "t", "k", "h", "u"]), "imatch")
    # Two rows for each range: each tail is followed by the head of the next range, the last one by the very first head.
    edges = found.where("tail is not null").select("doc_id", "k", "h", "u", "tail", "text")
    order = Window.orderBy("k", "h", "u", "tail")
    follows = edges.select("k", "h", "u", "tail").withColumn("v", F.coalesce(F.lead("u").over(order), F.first("u").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    pairs = edges.where("tail = 1").join(follows.where("tail = 1").select(F.col("u").alias("w"), "v"), F.col("u") == F.col("w"))
    pairs = pairs.join(edges.where("tail = 0").select(F.col("u").alias("x"), F.col("text").alias("next")), F.col("v") == F.col("x"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        terms = shared.value
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 19):
                own, after = (subset_hashes(part.column(i), terms) for i in (1, 2))
                yield _judged(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), own, part.column(2).to_pylist(), after)), terms)

    met = map_arrow(pairs, meet, _RESULT, ["doc_id", "text", "next"])
    every = found.where("tail is null").select(*met.columns).union(met)
    return every.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), F.lower(F.hex("own")).alias("fingerprint"),
        F.lower(F.hex("edited")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
