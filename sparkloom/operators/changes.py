"""Snapshot differences, versions, freshness and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def identity(df: DataFrame, path: str, section: str, index: str, content: str) -> DataFrame:
    """doc_key, content_hash, stable_key and version_id: the first survives edits of the content, the last doesn't."""
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    out = df.withColumn("doc_key", short(F.col(path))).withColumn("content_hash", F.sha2(F.col(content), 256))
    out = out.withColumn("stable_key", short(F.concat(F.col(path), F.lit("::"), F.col(section), F.lit("::"), F.col(index).cast("string"))))
    return out.withColumn("version_id", short(F.concat("stable_key", F.lit(":"), "content_hash")))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed, changed or same. A full join on the key; nothing but key and digest is shuffled."""
    a = old.select(F.col(key).alias("k_old"), F.col(digest).alias("d_old"))
    b = new.select(F.col(key).alias("k_new"), F.col(digest).alias("d_new"))
    change = F.when(F.col("k_old").isNull(), "added").when(F.col("k_new").isNull(), "removed").when(F.col("d_old") != F.col("d_new"), "changed").otherwise("same")
    return a.join(b, F.col("k_old") == F.col("k_new"), "full").select(F.coalesce("k_new", "k_old").alias(key), change.alias("change"))


def tombstones(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.select(key).join(new.select(key), key, "left_anti")


def merge(existing: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: updates replace rows of equal key."""
    return existing.join(updates.select(key), key, "left_anti").unionByName(updates, allowMissingColumns=True)


def link_freshness(links: DataFrame, current: DataFrame, card: str, key: str, pin: str) -> DataFrame:
    """(card, freshness): tombstoned if a linked key has no current version, else drifted if one differs from its pin, else verified."""
    now = current.groupBy(key).agg(F.max("version").alias("now")).withColumnRenamed(key, "k")
    joined = links.join(now, F.col(key) == F.col("k"), "left")
    state = joined.groupBy(card).agg(F.bool_or(F.col("now").isNull()).alias("gone"), F.bool_or(F.coalesce(F.col("now") != F.col(pin), F.lit(False))).alias("drift"))
    return state.select(card, F.when(F.col("gone"), "tombstoned").when(F.col("drift"), "drifted").otherwise("verified").alias("freshness"))


def orphans(links: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    return links.join(targets.select(F.col(target).alias("t")), F.col(key) == F.col("t"), "left_anti")
