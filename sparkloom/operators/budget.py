"""Selection under a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written

#: Ranks that are packed first; after them most queries have room for little.
HEAD = 1_000
#: Rows that a task holds before it leaves out what can't be taken.
HELD = 500_000
#: Steps of all queries that are broadcast; more are joined by a shuffle.
BROADCAST_STEPS = 1_000_000


def _fitting(rows: DataFrame) -> DataFrame:
    """Of rows (q, rank, tokens, budget) at least those that can be taken: of each size in a query the first budget // tokens by rank.

    What is used never falls, so once a row doesn't fit, no later row of its size does.
    """

    def first(q: pa.Array, numbers: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        codes = q.dictionary_encode(null_encoding="encode").indices.to_numpy()
        rank, tokens, most = numbers
        order = np.lexsort((rank, tokens, codes))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(codes[order]) != 0) | (np.diff(tokens[order]) != 0)
        nth = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        kept = np.sort(order[nth < (most // tokens)[order]])
        return q.take(pa.array(kept)), numbers[:, kept]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, parts, n = [], [], 0

        def joined() -> tuple[pa.Array, np.ndarray]:
            return first(pa.concat_arrays(qs), np.concatenate(parts, axis=1))

        def batch(q: pa.Array, numbers: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([q, *[pa.array(x) for x in numbers]], names=["q", "rank", "tokens", "budget"])

        for b in batches:
            qs.append(b.column(0))
            parts.append(np.stack([b.column(i).to_numpy() for i in (1, 2, 3)]))
            n += b.num_rows
            if n > HELD:
                q, numbers = joined()
                if len(q) > HELD // 2:  # what is left is given out as it is
                    yield batch(q, numbers)
                    qs, parts, n = [], [], 0
                else:
                    qs, parts, n = [q], [numbers], len(q)
        if n:
            yield batch(*joined())

    return rows.mapInArrow(step, rows.schema)


def _taken(rows: DataFrame) -> DataFrame:
    """(q, rank, used) of the rows that are taken, with the tokens used up to them."""
    schema = T.StructType([rows.schema["q"], T.StructField("rank", T.LongType()), T.StructField("used", T.LongType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = None, 0
        for batch in batches:
            out = []
            for key, rank, size, most in zip(*(c.to_pylist() for c in batch.columns)):
                if last is None or key != last[0]:
                    last, used = (key,), 0
                if used + size <= most:
                    used += size
                    out.append((key, rank, used))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=schema.names)

    return rows.repartition("q").sortWithinPartitions("q", "rank").mapInArrow(step, schema)


def greedy_fill(ranked: DataFrame, query: str, rank: str, tokens: str, budget: int | str) -> DataFrame:
    """ranked plus used and included: taken in order, what doesn't fit is skipped and later smaller rows may still fit.

    The choice depends on what was taken before, so a running sum would be wrong. It is made among the first HEAD ranks, then among the later rows that can be taken at all: those of no more than what is left, and of each size
    no more than that holds, so about budget * ln(budget) rows, however many the query has. These pass one by one, sorted by query and rank; what is used goes from the taken rows to all others, which stay where they are.
    ranked is read three times. Ranks are whole numbers from 1, each once in a query; tokens are not negative, a row without a number is left out. budget: tokens, or a column that holds each query's.
    """
    most = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    sized = ranked.select(F.col(query).alias("q"), F.col(rank).cast("long").alias("rank"), F.col(tokens).cast("long").alias("tokens"), most.cast("long").alias("budget"))
    fitting = "tokens > 0 and tokens <= budget"
    head = written(_taken(sized.where((F.col("rank") <= HEAD) & F.expr(fitting))), "taken")
    spent = head.groupBy(F.col("q").alias("__q")).agg(F.max("used").alias("spent"))
    spent = F.broadcast(spent) if head.count() <= BROADCAST_STEPS else spent
    after = lambda rows: rows.join(spent, F.col("q").eqNullSafe(F.col("__q")), "left").withColumn("spent", F.coalesce("spent", F.lit(0)))
    later = after(sized.where(F.col("rank") > HEAD)).select("q", "rank", "tokens", (F.col("budget") - F.col("spent")).alias("budget")).where(fitting)
    later = after(_taken(_fitting(later))).select("q", "rank", (F.col("used") + F.col("spent")).alias("used"))
    taken = written(head.union(later), "taken")
    # A step lasts until the next one; it is cut where ranks double, so that a row meets only the steps among ranks of its magnitude.
    doubled = lambda n: F.floor(F.log2(n.cast("double"))).cast("int")
    until = F.lead("rank").over(Window.partitionBy("q").orderBy("rank"))
    steps = taken.select(F.col("q").alias("__q"), F.col("rank").alias("__from"), until.alias("__until"), F.col("used").alias("__used"))
    steps = steps.withColumn("__size", F.explode(F.sequence(doubled(F.col("__from")), F.coalesce(doubled(F.col("__until")), F.lit(63)))))
    small = taken.count() + 64 * taken.select("q").distinct().count() <= BROADCAST_STEPS
    met = F.col(query).eqNullSafe(F.col("__q")) & (doubled(F.col(rank)) == F.col("__size")) & (F.col(rank) >= F.col("__from")) & (F.col("__until").isNull() | (F.col(rank) < F.col("__until")))
    out = ranked.join(F.broadcast(steps) if small else steps, met, "left")
    fits = F.coalesce(((F.col(tokens) == 0) & (most >= 0)) | ((F.col(tokens) > 0) & (F.col("__from") == F.col(rank))), F.lit(False))
    return out.select(*ranked.columns, F.coalesce("__used", F.lit(0).cast("long")).alias("used"), fits.alias("included"))


def first_per_source(ranked: DataFrame, query: str, source: str, rank: str) -> DataFrame:
    """ranked plus new_rank: each source's first row before any repeat, order kept otherwise; only with two sources or more."""
    nth = F.row_number().over(Window.partitionBy(query, source).orderBy(rank))
    several = F.min(source).over(Window.partitionBy(query)) != F.max(source).over(Window.partitionBy(query))
    out = ranked.withColumn("nth", nth).withColumn("later", several & (F.col("nth") > 1))
    return out.withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy("later", rank))).drop("nth", "later")
