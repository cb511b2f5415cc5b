"""Content-addressed reuse: what was chunked and embedded before is not done again."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.config import EngineConfig


def content_key(path: str = "path", text: str = "text"):
    return F.sha2(F.concat(F.col(path), F.lit("\0"), F.sha2(F.col(text).cast("binary"), 256)).cast("binary"), 256)


def misses(live: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return live.join(store.select(key), key, "left_anti")


def retained(store: DataFrame, live: DataFrame, key: str) -> DataFrame:
    return store.join(live.select(key).distinct(), key, "left_semi")


def reuse(live: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """One row (reused, fresh, dropped): distinct keys that both have, that only live has, that only the store has."""
    a, b = live.select(key).distinct().withColumn("l", F.lit(1)), store.select(key).distinct().withColumn("s", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("s").isNotNull()).alias("reused"), F.count_if(F.col("s").isNull()).alias("fresh"), F.count_if(F.col("l").isNull()).alias("dropped"))


def fingerprint(cfg: EngineConfig, source: str) -> str:
    """Names the settings and the code that chunks were made with; a change makes them stale."""
    return hashlib.sha256(f"{cfg!r}\0{source}".encode()).hexdigest()


class TableStore:
    """Versioned tables under a root. A version is written whole and becomes current by its manifest, which is last;
    readers keep the version they began with."""

    def __init__(self, spark: SparkSession, root: str, mark: str):
        self.spark, self.root, self.mark = spark, root.rstrip("/"), mark

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def current(self) -> str | None:
        fs, p = self._fs(f"{self.root}/manifest")
        if not fs.exists(p):
            return None
        last = self.spark.read.schema("version string, mark string, seq long").json(f"{self.root}/manifest").where(F.col("mark") == self.mark).orderBy(F.desc("seq")).first()
        return last["version"] if last else None

    def read(self, name: str, schema: str) -> DataFrame:
        """A table of the current version, empty without one or if it cannot be read."""
        version = self.current()
        fs, p = self._fs(f"{self.root}/{version}/{name}")
        if version is None or not fs.exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{version}/{name}")

    def save(self, tables: dict[str, DataFrame], seq: int) -> str:
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        self.spark.createDataFrame([(version, self.mark, seq)], "version string, mark string, seq long").coalesce(1).write.mode("append").json(f"{self.root}/manifest")
        return version
