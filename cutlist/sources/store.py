"""A keyed table as a log of versions: the newest row of a key counts, and a row may say that its key is gone.

A version is a folder that is written whole, so writing it again changes nothing.
Compaction folds all versions up to one into a base, and then adds the base to a
manifest; readers go by the newest base of the manifest, so a compaction that
breaks off leaves what was read before. Earlier files stay until they are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedStore:
    """Rows of ``columns`` (a schema in words) by ``keys`` in folder ``path``; ``create`` comes first."""

    def __init__(self, spark: SparkSession, path: str, columns: str, keys: tuple[str, ...]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.columns, self.schema = [c.split()[0] for c in columns.split(", ")], columns

    def create(self) -> KeyedStore:
        """An empty store; one that is there stays."""
        self.spark.createDataFrame([], "base int").write.mode("ignore").parquet(f"{self.path}/manifest")
        for part in ("log", "base"):
            self.spark.createDataFrame([], f"{self.schema}, gone boolean").write.mode("ignore").parquet(f"{self.path}/{part}/v=-1")
        return self

    def append(self, rows: DataFrame, version: int, gone: bool = False) -> None:
        """``rows`` become version ``version`` (from 0); or, with ``gone``, their keys are removed by it."""
        empty = self.spark.createDataFrame([], self.schema)
        full = empty.unionByName(rows.select(*(self.keys if gone else self.columns)), allowMissingColumns=True).withColumn("gone", F.lit(gone))
        full.write.mode("overwrite").parquet(f"{self.path}/log/v={version}")

    def _versions(self, part: str) -> DataFrame:
        at = f"{self.path}/{part}"
        return self.spark.read.schema(f"{self.schema}, gone boolean, v int").option("basePath", at).parquet(at)

    def version(self, version: int) -> DataFrame:
        """The rows that one version wrote."""
        return self._versions("log").filter(F.col("v") == version).select(*self.columns)

    def _newest(self, upto: int | None) -> DataFrame:
        bases = self.spark.read.schema("base int").parquet(f"{self.path}/manifest")
        base = (bases if upto is None else bases.filter(F.col("base") <= upto)).agg(F.max("base")).first()[0]
        base = -1 if base is None else base
        rows = self._versions("base").filter(F.col("v") == base).unionByName(self._versions("log").filter(F.col("v") > base))
        if upto is not None:
            rows = rows.filter(F.col("v") <= upto)
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*[c for c in self.columns if c not in self.keys], "gone"), "v").alias("s"))
        return newest.select(*self.keys, "s.*").filter("not gone")

    def read(self, upto: int | None = None) -> DataFrame:
        """The newest row of each key that is not gone; of versions up to ``upto`` alone, if given."""
        return self._newest(upto).select(*self.columns)

    def compact(self, upto: int) -> None:
        """Fold all versions up to ``upto`` into a base."""
        self._newest(upto).select(*self.columns, "gone").write.mode("overwrite").parquet(f"{self.path}/base/v={upto}")
        self.spark.createDataFrame([(upto,)], "base int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
