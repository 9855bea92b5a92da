"""Shared helpers of the llm operators: table access, durable intermediate tables, Arrow slicing."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that a vectorised step holds as 8-byte words at once.
SLICE_BYTES = 1 << 20
#: Column of the row key that numbered adds.
ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package when it isn't installed on the workers' path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one of this process, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        found = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stash_path = path
    return back


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stashed inside is deleted at the end, when its readers have written their results."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


def kept(df: DataFrame) -> DataFrame:
    """df, stashed within scratch, which outlives it."""
    _SCRATCH[-1].remove(df._stash_path)
    if len(_SCRATCH) > 1:
        _SCRATCH[-2].append(df._stash_path)
    return df


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame) -> DataFrame:
    """df with a unique key of each row, ROW, written once so that it stays the same wherever it is read."""
    return stash(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def unstash(*frames: DataFrame) -> None:
    """Delete stashed tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            remove(df.sparkSession, path)


#: Rows of one key that make it a frequent one, at least.
OFTEN = 1000
#: Frequent keys are at most this many, as each holds more than this part of all rows.
FREQUENT = 10_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], n_col: str) -> DataFrame:
    """Inner join by keys, which are unique in right; right's other columns come with the prefix ``__right_``.

    n_col of right says how many rows of left have the key. Keys of more than OFTEN rows and of more than the FREQUENT-th part of
    all rows are so few that they are broadcast, so their rows stay where they are; only the other keys are shuffled.
    Both sides should be written tables, as left may be read twice.
    """
    other = [F.col(c).alias(f"__right_{c}") for c in right.columns if c not in keys]
    right = right.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *other)
    n = F.col(f"__right_{n_col}")
    rows, most = right.agg(F.sum(n), F.max(n)).first()
    bar = max(OFTEN, (rows or 0) // FREQUENT)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__key_{k}"))
    drop = [f"__key_{k}" for k in keys]
    if (most or 0) <= bar:
        return left.join(right, same).drop(*drop)
    often = F.broadcast(right.where(n > bar))
    few = left.join(often.select(*drop), same, "left_anti").join(right.where(n <= bar), same)
    return left.join(often, same).drop(*drop).unionByName(few.drop(*drop))


def ranked(df: DataFrame, order: list) -> DataFrame:
    """df with rank (1, 2, ... in that order) and rows (how many there are), written: sorted by ranges, each of which begins after the rows of those before."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = stash(placed.withColumn("__range", F.shiftright("__at", 33)), "ranked")
    sizes = {r[0]: r[1] for r in placed.groupBy("__range").count().collect()}  # one row for each range
    ahead, before = [(-1, 0)], 0
    for k in sorted(sizes):
        ahead.append((k, before))
        before += sizes[k]
    starts = F.broadcast(spark.createDataFrame(ahead, "__key bigint, __ahead bigint"))
    out = placed.join(starts, F.col("__range") == F.col("__key")).withColumn("rank", F.col("__at") - F.shiftleft("__range", 33) + F.col("__ahead") + 1)
    return out.withColumn("rows", F.lit(before)).drop("__at", "__range", "__key", "__ahead")


def map_arrow(df: DataFrame, step: Callable, schema: str, columns: list[str]) -> DataFrame:
    """mapInArrow of step(iterator of batches of the given columns) -> iterator of dicts of columns, cast to schema."""
    ship(df.sparkSession)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in step(batches):
            batch = pa.RecordBatch.from_pydict(out)
            yield batch if batch.schema.types == kinds.types else batch.cast(pa.schema(kinds, metadata=None))

    return df.select(*columns).mapInArrow(run, schema)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of batch with at most limit bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def utf8_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - (at[0] if len(at) else 0)


def sql_text(col) -> F.Column:
    """Null text counts as empty."""
    return F.coalesce(col, F.lit(""))
