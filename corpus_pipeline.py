"""The corpus pipeline: documents in, packed training sequences out.

STAGES are applied in order, each to all rows that the last one kept: rows in no known language go; repeated runs of lines are
cut, all but the first copy, and documents of which nothing is left go; one document of each near-duplicate group stays;
documents with a benchmark item go; the rest is packed. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontam, langid, linededup, packing, simhash
from sparkloom.llm._common import ROW, kept, numbered, remove, scratch, shared_dir, ship, stash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what langid.keep_known keeps. A table without the column lang keeps everything that has a letter, as nothing is learned.

    Defined cases: null, empty and letterless texts go; so does everything of an empty table; rows with a null id or language are judged by their text;
    repeated rows are judged each; other columns come through as they are.
    """
    if "lang" not in docs.columns:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    filters = langid.fit(docs)
    return langid.keep_known(docs, filters) if filters.languages else docs.where(F.col("text").rlike(r"\p{L}"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated runs of lines. Documents that had text and lose all of it go; n_chars, where there, follows the text.

    Defined cases: null and empty texts stay, as they lose nothing; of repeated rows the first keeps its text and the others go, if they are long enough to be cut; null ids count as smallest;
    an empty table gives an empty one.
    """
    ship(spark)
    names = docs.columns
    cut = linededup.dedup_lines(docs)
    left = cut.where((F.col("lines_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in names:
        length = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        left = left.withColumn("n_chars", F.when(F.col("lines_removed") == 0, F.col("n_chars")).otherwise(length))
    return left.select(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest id, null before others. Five-word shingles, similarity 0.8.

    Defined cases: null text counts as empty, and texts without words are alike, so one of them stays; of repeated rows one stays, any of them; a text of fewer words than five is one shingle;
    an empty table gives an empty one.
    """
    rows = numbered(docs)
    ids = rows.select(F.col(ROW).alias("r"), F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    with scratch(spark):
        found = ids.join(simhash.similar_rows(rows, size=5, similarity=0.8), F.col("r") == F.col("row"))
        first = found.groupBy("root").agg(F.min(F.struct("id", "row")).alias("first"))
        keep = kept(stash(first.select(F.col("first.row").alias("__keep")), "keep"))
    return rows.join(keep.hint("merge"), F.col(ROW) == F.col("__keep"), "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which an item of benchmark is found go, each judged by its own text.

    Defined cases: null and wordless texts hold no item; rows that share an id or have none are told apart; an empty benchmark removes nothing.
    """
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What packing.pack_documents returns; its defined cases hold: null and empty texts are the end id alone, repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each result is written to the shared folder and read again by the next, then deleted with what its stage has stashed."""
    base = f"{shared_dir(spark)}/sparkloom/pipeline-{uuid.uuid4().hex}"
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if done:
            remove(spark, done)
        done = f"{base}/{name}"
        docs = spark.read.schema(docs.schema).parquet(done)
    return STAGES[-1][1](spark, docs, sf_dir)
