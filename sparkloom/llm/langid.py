"""Language identification by language-bitmask n-gram filters.

One Bloom filter for each length of n-gram (3, 4 and 5 bytes of the lower-cased text, everything but letters made a
space) holds all languages at once: a slot is a row of bits, one per language, so that the AND of an n-gram's slots gives every
language that contains it. A text's hits are counted per language (population counts) and corrected for each filter's false
positives; the language with the largest share of the n-grams wins.

Fitting uses a bounded sample of labelled rows (SAMPLE_ROWS, by a hash of id and text) and keeps a language's n-grams that
occur in MIN_SHARE of its sampled texts or more, and not under a tenth as often as in another language. Prediction reads
every whole text.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from ._common import map_arrow, ship, text_slices, utf8_buffers

ORDERS = (3, 4, 5)
HASHES = 3
SAMPLE_ROWS = 8000
MIN_SHARE = 0.02
_LETTER = np.array([chr(i).isalpha() if i < 128 else True for i in range(256)])


def _grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every n-gram that begins with a letter or is led by one space."""
    data, offsets = utf8_buffers(pc.utf8_lower(texts))
    if len(data) < order:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = _LETTER[data]
    clean = np.where(letter, data, 32).astype(np.uint64)
    n = len(data) - order + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(order):
            h = h << np.uint64(8) | clean[k : k + n]
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keep = (text[:n] == text[order - 1 :]) & letter[1 : n + 1] if order > 1 else np.ones(n, bool)
    return h[keep], text[:n][keep]


@dataclasses.dataclass
class Filters:
    languages: list[str]
    tables: dict[int, np.ndarray]
    false_rate: dict[int, np.ndarray]
    common: str | None

    def masks(self, order: int, h: np.ndarray) -> np.ndarray:
        """(words of 64 languages, n-grams): the languages that contain each n-gram."""
        table = self.tables[order]
        a, b = W.mix(h), W.mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        out = None
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                got = table[:, ((a + np.uint64(k) * b) & np.uint64(table.shape[1] - 1)).astype(np.int64)]
                out = got if out is None else out & got
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, coverage) of each text. score: the winner's part of all languages' shares."""
        hits = np.zeros((len(self.languages), len(texts)))
        seen = np.zeros(len(texts))
        for order in ORDERS:
            h, text = _grams(texts, order)
            n = np.bincount(text, minlength=len(texts))
            seen += n
            if not len(h) or not self.languages:
                continue
            masks = self.masks(order, h)
            for i in range(len(self.languages)):
                own = np.bincount(text[(masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=len(texts))
                f = self.false_rate[order][i]
                hits[i] += np.maximum(0, (own - n * f) / (1 - f)) if f < 1 else 0
        has = [any(map(str.isalpha, t)) for t in texts.to_pylist()]
        share = hits / np.maximum(seen, 1)
        total = share.sum(axis=0)
        best = share.argmax(axis=0) if self.languages else np.zeros(len(texts), int)
        top = share[best, np.arange(len(texts))] if self.languages else np.zeros(len(texts))
        score = np.where(total > 0, top / np.where(total > 0, total, 1), 0.0)
        names, known = [], self.common is not None
        for i, ok in enumerate(has):
            names.append("und" if not ok or not known else self.languages[best[i]] if total[i] > 0 else self.common)
        und = np.array([x == "und" for x in names], bool)
        return names, np.where(und, 0.0, score), np.where(und, 0.0, np.minimum(top, 1.0))


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Filters:
    """Filters from the labelled rows that are not held out.

    Defined cases: rows without text or label teach nothing; without any labelled row the filters know no language; repeated rows
    count each, but the sample takes all of them or none; languages too rare for the sample's share are taken whole.
    """
    ship(docs.sparkSession)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Filters([], {}, {}, None)
    languages = sorted(sizes)
    share = min(1.0, sample_rows / sum(sizes.values()))
    sample = labelled.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < F.lit(max(1, round(1_000_000 * share))))
    if share < 1 and min(sizes.values()) * share < 50:  # rare languages are sampled whole, up to the bound
        rare = [x for x in languages if sizes[x] * share < 50]
        sample = labelled.where(
            F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000))
            < F.when(F.col("lang").isin(rare), F.least(F.lit(1_000_000), F.lit(50_000_000) / _size_of(sizes, "lang"))).otherwise(round(1_000_000 * share))
        )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                lang = np.array(part.column(1).to_pylist(), object)
                for order in ORDERS:
                    h, text = _grams(part.column(0), order)
                    # h holds its bytes, so (text, n-gram) fits 64 bits
                    both = np.unique(text.astype(np.uint64) << np.uint64(40) | h)
                    text, h = (both >> np.uint64(40)).astype(np.int64), both & np.uint64((1 << 40) - 1)
                    for x in sorted(set(lang.tolist())):
                        gram, n = np.unique(h[(lang == x)[text]], return_counts=True)
                        yield {"lang": pa.array([x] * len(gram), pa.string()), "ord": np.full(len(gram), order, np.int32), "gram": gram.view(np.int64), "n": n.astype(np.int64)}

    counts = map_arrow(sample, step, "lang string, ord int, gram bigint, n bigint", ["text", "lang"]).groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))
    used = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = F.lit(0.0)
    for x, n in used.items():
        least = F.when(F.col("lang") == x, float(MIN_SHARE * n)).otherwise(least)
    # At most 1 / MIN_SHARE times the mean n-grams of a text pass, for each language.
    rows = counts.where(F.col("n") >= least).toArrow().to_pandas()
    rows["share"] = rows["n"] / rows["lang"].map(used)
    rows = rows[rows["share"] >= 0.1 * rows.groupby(["ord", "gram"])["share"].transform("max")]
    tables, rates = {}, {}
    for order in ORDERS:
        own = rows[rows["ord"] == order]
        most = int(own.groupby("lang").size().max()) if len(own) else 1
        slots = 1 << max(10, (24 * most - 1).bit_length())
        filters = Filters(languages, {order: np.zeros((len(languages) + 63 >> 6, slots), np.uint64)}, {}, None)
        table = filters.tables[order]
        for i, x in enumerate(languages):
            h = own.loc[own["lang"] == x, "gram"].to_numpy(np.int64).view(np.uint64)
            a, b = W.mix(h), W.mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
            for k in range(HASHES):
                with np.errstate(over="ignore"):
                    at = ((a + np.uint64(k) * b) & np.uint64(slots - 1)).astype(np.int64)
                table[i // 64, at] |= np.uint64(1) << np.uint64(i % 64)
        tables[order] = table
        rates[order] = np.array([(table[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() ** HASHES for i in range(len(languages))])
    return Filters(languages, tables, rates, max(languages, key=lambda x: (sizes[x], x)))


def _size_of(sizes: dict[str, int], col: str) -> Column:
    out = F.lit(1)
    for x, n in sizes.items():
        out = F.when(F.col(col) == x, n).otherwise(out)
    return out


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, coverage) of every row of docs.

    Defined cases: `und` with score 0 where text is null or has no letter, or nothing was learned; the most frequent
    language with score 0 where no n-gram is known; ties go to the language that sorts first; repeated rows stay; an
    empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found = shared.value
        for batch in batches:
            for part in text_slices(batch, text_col):
                lang, score, coverage = found.predict(pc.fill_null(part.column(1), ""))
                yield {"doc_id": part.column(0), "held_out": part.column(2), "lang_pred": pa.array(lang, pa.string()), "score": score, "coverage": coverage}

    kind = dict(docs.dtypes)[id_col]
    marked = docs.select(id_col, text_col, held_out(F.col(id_col)).alias("__held_out"))
    return map_arrow(marked, step, f"doc_id {kind}, held_out boolean, lang_pred string, score double, coverage double", [id_col, text_col, "__held_out"])


def keep_known(docs: DataFrame, filters: Filters, least_coverage: float = 0.05, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a known language: neither `und` nor nearly without known n-grams.

    Defined cases: null, empty and letterless texts go; repeated rows stay or go together; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    where = docs.columns.index(text_col)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            for part in text_slices(batch, text_col):
                lang, _, coverage = found.predict(pc.fill_null(part.column(where), ""))
                yield part.filter(pa.array((np.array(lang) != "und") & (coverage >= least_coverage)))

    return docs.mapInArrow(step, docs.schema)
