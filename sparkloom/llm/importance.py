"""Importance resampling towards a target: bucketed n-gram features, one gain a bucket, noisy scores, the best share drawn.

Both corpora become inverted postings of hashed features, (bucket, rows, counts), in blocks of BLOCK_ROWS documents. The blocks are
shuffled by bucket and meet the totals of both corpora there, from which each bucket's gain is computed on the spot; what a
bucket gives to a document is emitted and summed by document. A bucket of a frequent word, which may hold every document, is split: its blocks are
dealt to as many parts as its postings need, and its totals, two numbers, go to each part. Drawing sorts the scores by ranges and adds
the sizes of the ranges before, so no task sees them all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, ranked, stash, text_slices, utf8_buffers
from .words import WORD_BYTES, spans

BUCKETS, NGRAM, SEED = 10_000, 1, 2024
MIN_WORDS, PERCENT = 20, 10
#: Documents in a block of postings, at most.
BLOCK_ROWS = 4096
#: Longest span whose checksum is taken byte by byte for all spans at once.
_SHORT = 64
_UPPER = np.array([0x41 <= i <= 0x5A for i in range(256)])


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_TABLE = _crc_table()


def crc32_spans(data: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each span of data."""
    size = to - at
    order = np.argsort(-size, kind="stable")
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    first = int((size > _SHORT).sum())
    place, left = at[order], size[order]
    for i in range(first):
        crc[i] = zlib.crc32(data[place[i] : place[i] + left[i]].tobytes()) ^ 0xFFFFFFFF
    alive = len(at)
    for k in range(int(left[first]) if first < len(at) else 0):
        alive = first + int(np.searchsorted(-left[first:alive], -k, side="left"))
        part = crc[first:alive]
        crc[first:alive] = _TABLE[(part ^ data[place[first:alive] + k]) & 0xFF] ^ (part >> 8)
    out = np.empty_like(crc)
    out[order] = crc ^ 0xFFFFFFFF
    return out


def features(texts: pa.Array, ngram: int = NGRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature): all runs of 1 to ngram words, joined by one space."""
    data, offsets = utf8_buffers(texts)
    data = np.where(_UPPER[data], data | 0x20, data)
    at, to, text = spans(data, offsets, WORD_BYTES)
    words = np.bincount(text, minlength=len(texts))
    if ngram > 1:  # words side by side, with one space after each
        size = to - at
        new = np.cumsum(size + 1) - size - 1
        flat = np.full(int((size + 1).sum()), 0x20, np.uint8)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(new, size) + step] = data[np.repeat(at, size) + step]
        data, at, to = flat, new, new + size
    owner, bucket = [text], [crc32_spans(data, at, to) % buckets]
    for n in range(2, ngram + 1):
        same = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
        owner.append(text[same])
        bucket.append(crc32_spans(data, at[same], to[same + n - 1]) % buckets)
    return words, np.concatenate(owner), np.concatenate(bucket).astype(np.int64)


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """One row for each row of docs, written: row (unique), id, words, n_features, and its buckets with their counts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                words, owner, bucket = features(part.column(2), ngram, buckets)
                cell, n = np.unique(owner * buckets + bucket, return_counts=True)
                ends = np.searchsorted(cell, np.arange(part.num_rows + 1) * buckets)
                yield {
                    "row": part.column(0), "id": part.column(1), "words": words, "n_features": np.bincount(owner, minlength=part.num_rows),
                    "bucket": _lists(ends, cell % buckets, pa.int32()), "n": _lists(ends, n, pa.int32()),
                }

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias(text_col))
    kind = dict(rows.dtypes)["id"]
    return stash(map_arrow(rows, step, f"row bigint, id {kind}, words bigint, n_features bigint, bucket array<int>, n array<int>", ["row", "id", text_col]), "features")


def _totals(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, features, postings) of a counted corpus: at most one row for each bucket leaves a task."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n, rows = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            bucket = batch.column(0).flatten().to_numpy()
            n += np.bincount(bucket, batch.column(1).flatten().to_numpy(), buckets).astype(np.int64)
            rows += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(rows)
        yield {"bucket": some, "features": n[some], "postings": rows[some]}

    local = map_arrow(found, step, "bucket int, features bigint, postings bigint", ["bucket", "n"])
    return local.groupBy("bucket").agg(F.sum("features").alias("features"), F.sum("postings").alias("postings"))


def _postings(found: DataFrame) -> DataFrame:
    """(bucket, block, rows, counts): inverted lists of the documents of one block."""

    def invert(held: list[pa.RecordBatch]) -> dict:
        size = np.concatenate([b.column(1).value_lengths().to_numpy() for b in held])
        row = np.repeat(np.concatenate([b.column(0).to_numpy() for b in held]), size)
        bucket, n = (np.concatenate([b.column(i).flatten().to_numpy() for b in held]) for i in (1, 2))
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.concatenate((first, [len(bucket)]))
        block = int(row[0]) if len(row) else 0
        return {"bucket": bucket[first], "block": np.full(len(first), block), "rows": _lists(ends, row[order], pa.int64()), "counts": _lists(ends, n[order], pa.int32())}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                if held and rows + part.num_rows > BLOCK_ROWS:
                    yield invert(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if held:
            yield invert(held)

    filled = found.where(F.size("bucket") > 0)
    return map_arrow(filled, step, "bucket int, block bigint, rows array<bigint>, counts array<int>", ["row", "bucket", "n"])


def weights(found: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(row, weight) of the rows of a counted corpus that have features: the sum of its buckets' gains, each as often as it is there.

    A bucket's gain is floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of its s of S features in the corpus and t of T in the target.
    """
    spark = found.sparkSession
    own, aim = stash(_totals(found, buckets), "totals"), stash(_totals(target, buckets), "totals")
    all_own, postings = own.agg(F.coalesce(F.sum("features"), F.lit(0)), F.coalesce(F.sum("postings"), F.lit(0))).first()
    all_aim = aim.agg(F.coalesce(F.sum("features"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, postings // 4_000_000)
    # A part of a bucket has at most a quarter of a task's fair share.
    split = F.greatest(F.lit(1), F.ceil(F.col("postings") / max(1.0, postings / parts / 4))).cast("int")
    met = own.join(aim.select("bucket", F.col("features").alias("t")), "bucket", "left").select("bucket", F.col("features").alias("s"), F.coalesce("t", F.lit(0)).alias("t"), split.alias("splits"))
    met = stash(met, "gains")  # one row for each bucket
    splits = F.broadcast(met.where("splits > 1").select("bucket", "splits"))  # of at most 4 * parts, and no more than all buckets
    dealt = _postings(found).join(splits, "bucket", "left").withColumn("part", F.when(F.col("splits") > 1, F.pmod(F.xxhash64("block"), "splits")).otherwise(0).cast("int"))
    totals = met.select("bucket", "s", "t", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("part"))
    ratio = (F.col("t") + 1.0) * F.lit(float(all_own + buckets)) / ((F.col("s") + 1.0) * F.lit(float(all_aim + buckets)))
    grouped = dealt.drop("splits").repartition(parts, "bucket", "part").hint("merge").join(totals.repartition(parts, "bucket", "part"), ["bucket", "part"])
    given = grouped.select(F.floor(1000 * F.log(ratio)).alias("gain"), F.explode(F.arrays_zip("rows", "counts")).alias("posting"))
    return given.groupBy(F.col("posting.rows").alias("row")).agg(F.sum(F.col("gain") * F.col("posting.counts")).alias("weight"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs: score is the weight with Gumbel noise of the id, rank its place among those drawn.

    Drawn are the floor(percent * N / 100) highest scores of the N rows with at least min_words words, ties to the smaller id.

    Defined cases: null text has no words; an empty or wordless target has no features, so t and T are zero; rows with a null id have the
    noise of an empty id and come first among ties; repeated rows are scored and drawn each, equal ones in any order; an empty table gives an empty
    result; other columns are ignored.
    """
    found = counted(docs, id_col, text_col, ngram, buckets)
    aim = counted(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), "id", "text", ngram, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    gained = weights(found, aim, buckets).withColumnRenamed("row", "r")
    scored = found.select("row", "id", "words", "n_features").join(gained.hint("merge"), F.col("row") == F.col("r"), "left")
    scored = stash(scored.select("row", "id", "words", "n_features", F.coalesce("weight", F.lit(0)).alias("weight")).withColumn("score", F.col("weight") + noise), "scores")
    drawn = ranked(scored.where(F.col("words") >= min_words), [F.desc("score"), F.asc("id"), F.asc("row")])
    result = scored.join(drawn.where(F.col("rank") <= F.floor(F.col("rows") * percent / 100)).select(F.col("row").alias("r"), "rank").hint("merge"), F.col("row") == F.col("r"), "left")
    return result.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def oracle_sql() -> str:
    """DuckDB SQL of op12 at its production parameters; CRC-32 is taken over the bytes of each distinct word."""
    fold = "list_reduce([4294967295::BIGINT] || bytes, lambda c, b: xor(tab.t[((xor(c, b) & 255) + 1)::INT], c >> 8))"
    return f"""
WITH RECURSIVE rounds(i, x, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM rounds WHERE k < 8
), tab AS (SELECT list(x ORDER BY i) AS t FROM rounds WHERE k = 8),
texts AS (
  SELECT 0 AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, NULL, coalesce(text, '') FROM benchmark
), split AS (
  SELECT row_number() OVER () AS r, side, id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts
), every AS (SELECT r, side, unnest(words) AS word FROM split),
dictionary AS (
  SELECT word, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT) AS bytes
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM every)
), hashed AS (SELECT word, xor({fold}, 4294967295) % 10000 AS bucket FROM dictionary, tab),
postings AS (SELECT r, side, bucket, count(*) AS n FROM every JOIN hashed USING (word) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM postings GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0) AS S_, coalesce(sum(t), 0) AS T_ FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (S_ + 10000)::DOUBLE / ((s + 1)::DOUBLE * (T_ + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, whole
), weights AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM postings JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT r, id AS doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (r) WHERE side = 0
), drawn AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (r)
"""
