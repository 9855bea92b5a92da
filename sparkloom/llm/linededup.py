"""Line deduplication by a suffix array over line-ID sequences, built by distributed prefix doubling, and its LCP intervals.

Every line with a word gets an ID, a 64-bit hash of the line without outer white space; blank lines are no part of the
sequence. A suffix is a position (row, place of the line); rows are told apart by a key of their own, not by the document id.
Rows whose whole sequences are equal are settled before anything is exploded: of such copies only the first can be an earlier
copy of anything, so only it enters the suffix array, however large the group is.

Doubling step k ranks positions by their first 2**k lines: the pairs (rank of p, rank of p + 2**k) of the step before are
counted, those that occur once leave, as no other suffix shares that prefix, and the rest are sorted by ranges; a pair's
number in that order is the new rank. So the positions in the order of their ranks are the suffix array as far as suffixes
share a prefix, and the positions of equal rank are its interval with a longest common prefix of 2**k lines or more. Doubling
goes on until every interval has one member. An interval between two powers of two, of depth d, is named by the two ranks of
step floor(log2(d)) that span d lines, at its start and at its end.

A run of lines is repeated when it has ``min_words`` words or more and an earlier copy. Cut are, for each position, the lines
of the deepest interval of 2**k >= min_words lines in which it is not the first, and for shorter runs two intervals of
their own depth: from a line forward to the first line that brings the words to ``min_words``, and from a line backward
likewise. (Given a repeated run around line q that starts at s: if the words from s to q reach min_words, the backward block
of q lies in the run, else the forward block of s does and covers q.) Their union is that of all maximal repeated runs, and
the first copy by document id and place stays.

Counts are added up before they are shuffled, and the members of an interval find it by joins that send frequent
intervals, of which there are few by their size, to the members instead (see spread_join).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ROW, kept, map_arrow, numbered, scratch, ship, spread_join, stash, unstash

#: Words that a repeated run of lines has at least.
MIN_WORDS = 10
_NULL_ID = -(2**63)
#: Lines of a cut that takes the whole text.
_ALL = 2**30


def _worded(text: str | None) -> list[int]:
    return [i for i, line in enumerate((text or "").split("\n")) if line and not line.isspace()]


def block_lengths(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the forward block from each line and of the backward block to it; 0 where the text ends before."""
    total = np.concatenate(([0], np.cumsum(words)))
    n, at = len(words), np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + min_words, side="left")
    start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    return np.where(end <= n, end - at, 0), np.where(total[1:] >= min_words, at - start + 1, 0)


def line_sequences(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(row, by, h0, h1, total, ids, forward, backward) of every row with a worded line: a hash of 128 bits of its line ids, its words, and arrays with one entry a
    line; by is the document id, a null one counts as the smallest."""
    names = ("ids", "forward", "backward")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            orders = pc.fill_null(batch.column(1).cast(pa.int64()), _NULL_ID).to_pylist()
            held: list[tuple] = []
            count = 0
            for key, by, text in zip(batch.column(0).to_pylist(), orders, batch.column(2)):
                lines = [x for x in map(str.strip, (text.as_py() or "").split("\n")) if x]
                if not lines:
                    continue
                ids = np.fromiter(map(digest, lines), np.uint64, len(lines)).view(np.int64)
                words = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
                forward, backward = block_lengths(words, min_words)
                raw = ids.tobytes()
                held.append((key, by, digest(raw, 1), digest(raw, 2), int(words.sum()), ids, forward.astype(np.int32), backward.astype(np.int32)))
                count += len(lines)
                if count > 1 << 16:
                    yield pack(held)
                    held, count = [], 0
            if held:
                yield pack(held)

    def pack(held: list[tuple]) -> dict:
        at = pa.array(np.concatenate(([0], np.cumsum([len(x[5]) for x in held]))).astype(np.int32))
        plain = {n: np.array([x[i] for x in held], np.uint64 if n in ("h0", "h1") else np.int64).view(np.int64) for i, n in enumerate(("row", "by", "h0", "h1", "total"))}
        return plain | {n: pa.ListArray.from_arrays(at, pa.array(np.concatenate([x[5 + i] for x in held]))) for i, n in enumerate(names)}

    schema = "row bigint, by bigint, h0 bigint, h1 bigint, total bigint, ids array<bigint>, forward array<int>, backward array<int>"
    return map_arrow(docs, step, schema, [ROW, id_col, text_col])


def _place() -> Column:
    """A position, in the order of copies."""
    return F.struct("by", "row", "at")


def intervals(members: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, first, number) of the values of keys that two members or more share; number is in their order. Written to the shared folder."""
    shared = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first")).where("n > 1")
    return stash(shared.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("number", F.monotonically_increasing_id()), "intervals")


def _members(members: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """(row, by, at, rank, later): the members of the intervals found; later where it is not the first one."""
    both = spread_join(members, found, list(keys), "n")
    return both.select("row", "by", "at", F.col("__right_number").alias("number"), (_place() != F.col("__right_first")).alias("later")).withColumnRenamed("number", "rank")


def suffix_levels(lines: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(2**k, (row, by, at, rank, later)) for k = 0, 1, ... of the positions whose first 2**k lines occur twice or more. lines: row, by, at, id.

    rank orders positions by those lines; later is false for the first position of a rank alone.
    """
    found = intervals(lines, "id")
    level = stash(_members(lines, found, "id"), "level")
    size = 1
    while not level.isEmpty():
        yield size, level
        ahead = F.max("rank").over(Window.partitionBy("row").orderBy("at").rangeBetween(size, size))
        pairs = stash(level.withColumn("then", ahead).where("then is not null").select("row", "by", "at", "rank", "then"), "pairs")
        unstash(found)
        found = intervals(pairs, "rank", "then")
        level = stash(_members(pairs, found, "rank", "then"), "level")
        unstash(pairs)
        size *= 2
    unstash(found)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, at, size): runs of size lines from place at that have an earlier copy. docs has a unique key ROW."""
    every = stash(line_sequences(docs, min_words, id_col, text_col), "sequences")
    whole = every.select("row", "by", F.lit(0).alias("at"), "h0", "h1", "total")
    copies = _copies(whole)
    first = every.join(copies.select(F.col("row").alias("c")), F.col("row") == F.col("c"), "left_anti")
    lines = stash(first.select("row", "by", F.posexplode("ids").alias("at", "id")), "lines")
    deep = 1 << (min_words - 1).bit_length()
    cuts, names, last = copies.where(F.col("total") >= min_words).select("row", "at", F.lit(_ALL).alias("size")), None, None
    covered = None
    for size, level in suffix_levels(lines):
        if size < deep:
            named = level.select(F.lit(size).alias("of"), "row", "at", "rank")
            names = named if names is None else names.union(named)
            continue
        later = level.where("later").select("row", "at", F.lit(size).alias("size"))
        if last is None:
            covered = later.select(F.col("row").alias("r"), F.col("at").alias("a"))
        else:  # where the next step has an interval too, that is the deeper one
            cuts = cuts.union(last.join(later.select(F.col("row").alias("r"), F.col("at").alias("a")), (F.col("row") == F.col("r")) & (F.col("at") == F.col("a")), "left_anti"))
        last = later
    if last is not None:
        cuts = cuts.union(last)
    if names is None:
        return cuts

    # The shorter runs: an interval of a block's depth, named by the two ranks that span it.
    one = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("ids") - 1).alias("at"), "forward", "backward"))
    wanted = F.array_distinct(F.array(
        F.struct(F.col("b.at").alias("at"), F.col("b.forward").alias("size")),
        F.struct((F.col("b.at") - F.col("b.backward") + 1).alias("at"), F.col("b.backward").alias("size")),
    ))
    blocks = first.select("row", "by", one.alias("b")).select("row", "by", F.explode(wanted).alias("b")).select("row", "by", "b.at", "b.size").where("size > 0").distinct()
    if covered is not None:  # a block that starts where a longer interval is cut lies in it, and so do all its later copies'
        blocks = blocks.join(covered, (F.col("row") == F.col("r")) & (F.col("at") == F.col("a")), "left_anti")
    blocks = blocks.withColumn("of_", F.expr("cast(shiftleft(1, cast(floor(log2(size) + 1e-9) as int)) as int)")).withColumn("at2", F.expr("at + size - of_"))
    head = names.select(F.col("of").alias("o1"), F.col("row").alias("d1"), F.col("at").alias("a1"), F.col("rank").alias("from"))
    tail = names.select(F.col("of").alias("o2"), F.col("row").alias("d2"), F.col("at").alias("a2"), F.col("rank").alias("to"))
    named = blocks.join(head, (F.col("of_") == F.col("o1")) & (F.col("row") == F.col("d1")) & (F.col("at") == F.col("a1")))
    named = named.join(tail, (F.col("of_") == F.col("o2")) & (F.col("row") == F.col("d2")) & (F.col("at2") == F.col("a2")))
    named = stash(named.select("row", "by", "at", "size", "from", "to"), "blocks")
    found = intervals(named, "size", "from", "to")
    both = spread_join(named, found, ["size", "from", "to"], "n")
    return cuts.union(both.where(_place() != F.col("__right_first")).select("row", "at", "size"))


def _copies(whole: DataFrame) -> DataFrame:
    """(row, at, total) of the rows whose whole sequence of lines an earlier row has."""
    shared = whole.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first")).where("n > 1")
    both = spread_join(whole, stash(shared, "copies"), ["h0", "h1"], "n")
    return stash(both.where(_place() != F.col("__right_first")).select("row", "at", "total"), "later")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, text without repeated runs, plus lines_removed; every row stays.

    Defined cases: null text stays null; a text of which all lines go becomes empty; the first copy, by document id
    and place, stays, so of repeated rows one keeps its text; every row is a document of its own, whatever its id; null
    ids count as smallest; an empty table gives an empty result. A column of docs named
    lines_removed is replaced.
    """
    ship(docs.sparkSession)
    docs = numbered(docs.drop("lines_removed"))
    with scratch(docs.sparkSession):
        found = kept(stash(repeated_runs(docs, min_words, id_col, text_col), "runs"))
    per_doc = found.groupBy("row").agg(F.collect_list(F.struct("at", "size")).alias("__cut")).withColumnRenamed("row", "__cut_row")
    # As many rows may be cut as there are documents, so this is a sorted merge at any size.
    joined = docs.join(per_doc.hint("merge"), F.col(ROW) == F.col("__cut_row"), "left").drop(ROW, "__cut_row")
    docs = docs.drop(ROW)
    names = docs.columns
    where = names.index(text_col)

    def cut(text: str, blocks: list[dict]) -> tuple[str, int]:
        at = _worded(text)
        depth = np.zeros(len(at) + 1, np.int64)
        start = np.array([b["at"] for b in blocks], np.int64)
        np.add.at(depth, start, 1)
        np.add.at(depth, np.minimum(len(at), start + np.array([b["size"] for b in blocks], np.int64)), -1)
        gone = {at[i] for i in np.flatnonzero(np.cumsum(depth)[:-1])}
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), len(gone)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(batch.num_columns - 1)
            touched = np.flatnonzero(blocks.is_valid().to_numpy(zero_copy_only=False))
            removed = np.zeros(batch.num_rows, np.int32)
            columns = [batch.column(i) for i in range(len(names))]
            if len(touched):
                texts = columns[where].to_pylist()
                for i in touched.tolist():
                    if texts[i] is not None:
                        texts[i], removed[i] = cut(texts[i], blocks[i].as_py())
                columns[where] = pa.array(texts, columns[where].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], names=[*names, "lines_removed"])

    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema.fields], T.StructField("lines_removed", T.IntegerType(), True)])
    return joined.mapInArrow(step, schema)
