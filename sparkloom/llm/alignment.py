"""Alignment of two tokenizers over the same bytes: elementary intervals, shared groups, links and their corpus-wide counts.

The ends of both tokenizers' tokens cut a text into elementary intervals; each lies in one token of either side and so is one overlap. An
end that both share closes a group. Links are products: of the tokens that end together, of each interval's two owners, or of a
group's two sides, as chosen. The texts of an Arrow batch are laid side by side, so a batch takes one pass of numpy.

Texts are tokenised once and the links of each text written as id pairs with their counts. Pairs are counted within each task before they are
shuffled. Of the counted pairs the common ones, of which there are COMMON at most as each is in more than that part of all
rows of pairs, are broadcast and looked up where the texts' rows are; only the others are joined.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, stash, text_slices

A_FILE, A_RANKS, B_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Pairs that are broadcast, at most.
COMMON = 100_000
#: Pairs that a task holds before it hands on their counts.
_HELD = 4_000_000


def elementary(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end, A owner, B owner, closed) of each elementary interval; both sides cover the same bytes. Closed: both owners end there."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def products(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) with low_a <= i < high_a and low_b <= j < high_b, for each group."""
    wide = high_b - low_b
    size = (high_a - low_a) * wide
    of = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    return low_a[of] + step // wide[of], low_b[of] + step % wide[of]


def links(kind: str, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token) of each link, then where each group ends in A and in B. kind: ends, overlaps or groups."""
    ends, a, b, closed = elementary(ends_a, ends_b)
    shared = ends[closed]
    high_a, high_b = (np.searchsorted(x, shared, side="right") for x in (ends_a, ends_b))
    if kind == "overlaps":
        return a, b, high_a, high_b
    if kind == "ends":
        low_a, low_b = a[closed], b[closed]
    else:
        low_a, low_b = (np.concatenate(([0], x[:-1])) if len(x) else x for x in (high_a, high_b))
    return *products(low_a, high_a, low_b, high_b), high_a, high_b


class Pair:
    """Both tokenizers: their ids of a text, and the bytes of their ids."""

    def __init__(self, a_ranks: str, pattern: str, b_file: str):
        import sentencepiece

        from .packing import read_ranks

        self.a, self.a_bytes = read_ranks(a_ranks, pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]

    def __call__(self, text: str | None) -> tuple[list[int], list[int]] | None:
        """Ids of A and of B, or None for no tokens: null, empty, or not given back byte by byte."""
        if not text:
            return None
        spaced = " " + text
        a, b, raw = self.a(spaced), self.model.encode(text, num_threads=1), spaced.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return a, b


class Aligner:
    """Alignment of the texts of a batch."""

    def __init__(self, pair: Pair, kind: str):
        self.pair, self.kind = pair, kind
        self.length = [np.array([len(x) for x in t], np.int64) for t in (pair.a_bytes, pair.b_bytes)]
        self.wide = len(pair.b_bytes)
        names = [[str(i) for i in range(len(t))] for t in self.length]
        self.names = [x + s for side, marks in zip(names, (",|", ",;")) for s in marks for x in side]

    def __call__(self, texts: list[str | None]) -> dict:
        """n_a, n_b, n_groups, n_links, groups (text) of each text; then for each text its distinct linked pairs as codes with how often."""
        found = [self.pair(t) for t in texts]
        ids, ends, count = [], [], []
        for side in (0, 1):
            n = np.array([len(f[side]) if f else 0 for f in found], np.int64)
            x = np.fromiter(itertools.chain.from_iterable(f[side] for f in found if f), np.int64, int(n.sum()))
            ids.append(x)
            count.append(n)
            # A gap of one before each text, so that none ends where another begins.
            ends.append(np.cumsum(self.length[side][x]) + np.repeat(np.arange(len(texts)), n))
        a, b, high_a, high_b = links(self.kind, *ends)
        text_of = np.repeat(np.arange(len(texts)), count[0])
        n_groups = np.bincount(text_of[high_a - 1], minlength=len(texts)) if len(high_a) else np.zeros(len(texts), np.int64)
        size = len(self.length[0]) * self.wide
        cell, n = np.unique(text_of[a] * size + ids[0][a] * self.wide + ids[1][b], return_counts=True)
        return {
            "n_a": count[0], "n_b": count[1], "n_groups": n_groups, "n_links": np.bincount(text_of[a], minlength=len(texts)), "groups": self._groups(ids, count, high_a, high_b),
            "cuts": np.searchsorted(cell, np.arange(len(texts) + 1) * size), "pair": cell % size, "n": n,
        }

    def _groups(self, ids: list[np.ndarray], count: list[np.ndarray], high_a: np.ndarray, high_b: np.ndarray) -> list[str]:
        others, base = (np.concatenate(([0], high_b[:-1])), high_a), 0
        marked = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
        for side, high in enumerate((high_a, high_b)):
            i = np.arange(len(ids[side]))
            group = np.searchsorted(high, i, side="right")
            closing = high[group] - 1 == i
            marked[i + others[side][group]] = base + ids[side] + closing * len(self.length[side])
            base += 2 * len(self.length[side])
        at = np.concatenate(([0], np.cumsum(count[0] + count[1]))).tolist()
        return ["".join(map(self.names.__getitem__, marked[x:y].tolist()))[:-1] for x, y in zip(at, at[1:])]


def alignments(docs: DataFrame, a_ranks: str, pattern: str, b_file: str, kind: str = "ends", digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs, written: row (unique), id, n_a, n_b, n_groups, n_links, groups, and the distinct linked pairs (A id times B's vocabulary plus B id) with counts.

    groups is `a1,a2|b1;a3|b2,b3`, or with digest its SHA-256 in lower-case hexadecimal; the empty string for a text without tokens.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        align = Aligner(Pair(a_ranks, pattern, b_file), kind)
        for batch in batches:
            for part in text_slices(batch, text_col):
                out = align(part.column(2).to_pylist())
                groups, cuts = out["groups"], pa.array(out["cuts"], pa.int32())
                if digest:
                    groups = [g and hashlib.sha256(g.encode()).hexdigest() for g in groups]
                yield {
                    "row": part.column(0), "id": part.column(1), **{k: out[k] for k in ("n_a", "n_b", "n_groups", "n_links")}, "groups": pa.array(groups, pa.string()),
                    "pair": pa.ListArray.from_arrays(cuts, pa.array(out["pair"], pa.int64())), "n": pa.ListArray.from_arrays(cuts, pa.array(out["n"], pa.int64())),
                }

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias(text_col))
    kinds = f"row bigint, id {dict(rows.dtypes)['id']}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pair array<bigint>, n array<bigint>"
    return stash(map_arrow(rows, step, kinds, ["row", "id", text_col]), "alignments")


def pair_counts(found: DataFrame, wide: int) -> DataFrame:
    """(pair, count, rows, best) of alignments, written: links and texts that hold the pair, and whether no other pair of its B id has more. wide: B's vocabulary."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> dict:
            pair, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            count = np.bincount(at, np.concatenate([h[1] for h in held]), len(pair)).astype(np.int64)
            held.clear()
            return {"pair": pair, "count": count, "rows": np.bincount(at, minlength=len(pair))}

        for batch in batches:
            held.append((batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()))
            if sum(len(h[0]) for h in held) > _HELD:
                yield flush()
        if held:
            yield flush()

    local = map_arrow(found, step, "pair bigint, count bigint, rows bigint", ["pair", "n"])
    counts = stash(local.groupBy("pair").agg(F.sum("count").alias("count"), F.sum("rows").alias("rows")).withColumn("b", F.col("pair") % wide), "pairs")
    most = counts.groupBy("b").agg(F.max("count").alias("most")).withColumnRenamed("b", "of")  # one row for each B id
    return stash(counts.join(F.broadcast(most), F.col("b") == F.col("of")).select("pair", "count", "rows", (F.col("count") == F.col("most")).alias("best")), "counts")


def align_documents(
    docs: DataFrame, a_ranks: str | None = None, pattern: str | None = None, b_file: str | None = None, kind: str = "ends", common: int = COMMON, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs; see the module. Files default to the public ones.

    Defined cases: null and empty texts, and texts that one side doesn't give back byte by byte, have no tokens: zeros and an empty
    digest; rows with a null id, repeated rows and rows that share an id are aligned and counted each; an empty table gives an empty result; other columns
    are ignored.
    """
    import public_tokenizers as public
    import sentencepiece

    spark = docs.sparkSession
    a_ranks, pattern, b_file = a_ranks or public.path(A_RANKS), pattern or public.PATTERN, b_file or public.path(B_FILE)
    found = alignments(docs, a_ranks, pattern, b_file, kind, True, id_col, text_col)
    counts = pair_counts(found, sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size())
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    bar = total // common
    top = counts.where(F.col("rows") > bar).select("pair", "count", "best").toArrow()  # fewer than common rows
    order = np.argsort(top.column(0).to_numpy())
    known = spark.sparkContext.broadcast([top.column(i).to_numpy()[order] for i in range(3)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Sums over common pairs, one row for each text (pair null); then the rows of its other pairs."""
        pairs, count, best = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                of = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy())
                pair, n = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
                place = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
                inside = pairs[place] == pair if len(pairs) else np.zeros(len(pair), bool)
                x, of_x, n_x = place[inside], of[inside], n[inside]
                sums, bests = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                np.add.at(sums, of_x, n_x * count[x])
                np.add.at(bests, of_x, n_x * best[x])
                row, rest = part.column(0).to_numpy(), ~inside
                m = int(rest.sum())
                yield {
                    "row": np.concatenate((row, row[of[rest]])), "pair": pa.array(np.concatenate((np.zeros(part.num_rows, np.int64), pair[rest])), mask=np.arange(part.num_rows + m) < part.num_rows),
                    "n": np.concatenate((np.zeros(part.num_rows, np.int64), n[rest])), "n_best": np.concatenate((bests, np.zeros(m, np.int64))), "count_sum": np.concatenate((sums, np.zeros(m, np.int64))),
                }

    parted = map_arrow(found, split, "row bigint, pair bigint, n bigint, n_best bigint, count_sum bigint", ["row", "pair", "n"])
    rare = parted.where("pair is not null").select("row", "n", F.col("pair").alias("p"))
    met = rare.join(counts.where(F.col("rows") <= bar).hint("merge"), F.col("p") == F.col("pair"))
    given = met.select("row", F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("n") * F.col("count")).alias("count_sum"))
    every = given.union(parted.where("pair is null").select("row", "n_best", "count_sum"))
    sums = every.groupBy(F.col("row").alias("r")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.join(sums.hint("merge"), F.col("row") == F.col("r")).select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256")
    )
