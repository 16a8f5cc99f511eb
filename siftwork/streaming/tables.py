"""Keyed tables that outlive a micro-batch: one version a batch, so that a retried batch starts where it started before."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class StateTable:
    """Versions of a table under a folder, named by the batch that wrote them.

    A batch reads the latest version of an earlier batch and overwrites its own, so running it twice gives the same
    table. Versions before the one just read are removed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def _folder(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Batches whose version is complete."""
        p, fs = self._folder()
        if not fs.exists(p):
            return []
        found = []
        for f in fs.listStatus(p):
            name = re.fullmatch(r"batch=(-?\d+)", f.getPath().getName())
            if name and fs.exists(f.getPath().suffix("/_SUCCESS")):
                found.append(int(name[1]))
        return sorted(found)

    def at(self, batch_id: int) -> str:
        return f"{self.path}/batch={batch_id}"

    def before(self, batch_id: int) -> DataFrame:
        """The table as the batches before this one left it; empty at first."""
        earlier = [v for v in self.versions() if v < batch_id]
        if not earlier:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.at(earlier[-1]))

    def latest(self) -> DataFrame:
        return self.before(2**62)

    def write(self, table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(self.at(batch_id))
        _, fs = self._folder()
        for old in [v for v in self.versions() if v < batch_id][:-1]:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at(old)), True)


class KeyStore:
    """Keys that earlier batches have seen, partitioned by the first two characters of the key."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key

    def before(self, batch_id: int, prefixes: list[str]) -> DataFrame:
        """Keys of earlier batches; only the folders of ``prefixes`` are read."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        schema = f"`{self.key}` string, batch bigint, prefix string"
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        from pyspark.sql import functions as F

        # batch is a folder level too: what a failed run of this batch left behind is not read
        d = self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)
        return d.where((F.col("batch") < batch_id) & F.col("prefix").isin(prefixes)).select(self.key)

    def write(self, keys: DataFrame, batch_id: int) -> None:
        from pyspark.sql import functions as F

        d = keys.select(self.key, F.substring(self.key, 1, 2).alias("prefix"))
        d.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/batch={batch_id}")
