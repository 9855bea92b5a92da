"""Keyed Parquet tables with merge by rewrite."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.changes import merge


class KeyedTable:
    """A table of versions under one path: a write makes a new version, and a numbered pointer file, made once, names it. Of two writers that start from one version the second fails."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _number(self) -> int:
        at = self._at(f"{self.path}/current")
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(at)), default=0) if self._fs.exists(at) else 0

    def _version(self, number: int) -> str:
        stream = self._fs.open(self._at(f"{self.path}/current/{number:012d}"))
        try:
            return bytes(b & 255 for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version, by default the last one."""
        number = self._number() if number is None else number
        return self.spark.read.parquet(f"{self.path}/{self._version(number)}") if number else None

    def replace(self, df: DataFrame, base: int | None = None) -> None:
        """Make df the version after base. Fails, and changes nothing, if another writer has made that version."""
        base = self._number() if base is None else base
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        pointer = self._fs.create(self._at(f"{self.path}/current/{base + 1:012d}"), False)
        pointer.write(bytearray(name.encode()))
        pointer.close()

    def upsert(self, updates: DataFrame) -> None:
        base = self._number()
        old = self.read(base)
        self.replace(updates if old is None else merge(old, updates, self.key), base)

    def delete(self, keys: DataFrame) -> None:
        base = self._number()
        old = self.read(base)
        if old is not None:
            self.replace(old.join(keys.select(self.key), self.key, "left_anti"), base)
