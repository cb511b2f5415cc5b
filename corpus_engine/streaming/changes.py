"""Change streams: debounce, incremental upkeep of tables, reconcile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpus_engine.config import DEFAULT, EngineConfig
from corpus_engine.functions import text as tx
from corpus_engine.operators.catalogue import difference, upsert

SCHEMA = "path string, op string, target string, ts timestamp"


def source(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of change rows from a folder of Parquet files; deletes are rows, since a file source sees none."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def watched(changes: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(path, op, ts): a move counts as a delete and a create; only notes and documents that are not protected."""
    each = changes.select(F.explode(F.when(F.col("op") == "move", F.array(F.struct("path", F.lit("delete").alias("op"), "ts"), F.struct(F.col("target").alias("path"), F.lit("create").alias("op"), "ts"))).otherwise(F.array(F.struct("path", "op", "ts")))).alias("c")).select("c.*")
    return each.where((tx.is_note(F.col("path")) | tx.is_document(F.col("path"), cfg)) & ~tx.is_protected(F.col("path")))


def debounced(changes: DataFrame, cfg: EngineConfig = DEFAULT, key: str = "path") -> DataFrame:
    """(path, first, last, n): bursts of changes with less than the quiet time between neighbours.

    Works on streams, with a watermark of the quiet time, and on tables. Changes exactly the quiet time apart are two
    bursts; the session gap is a microsecond less than it, as sessions that touch would be merged.
    """
    gap = f"{round(cfg.debounce_seconds * 1_000_000) - 1} microseconds"
    marked = changes.withWatermark("ts", f"{cfg.debounce_seconds} seconds") if changes.isStreaming else changes
    return marked.groupBy(key, F.session_window("ts", gap)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path of a micro-batch."""
    order = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("op"))
    return changes.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def arrived(folders: DataFrame, listing: DataFrame) -> DataFrame:
    """Files below folders that appeared: an equi-join on every folder above a file, not a prefix search."""
    above = listing.select("path", F.explode(tx.ancestors(F.col("path"))).alias("folder"))
    return above.join(folders.select("folder").distinct(), "folder").select("path").distinct()


def applied(state: DataFrame, changes: DataFrame, current: DataFrame) -> DataFrame:
    """state with the changed paths' rows replaced by those in current, and the deleted ones removed."""
    last = latest(changes)
    gone = last.where("op = 'delete'").select("path")
    live = current.join(last.where("op <> 'delete'").select("path"), "path", "left_semi")
    return upsert(state, live, gone.unionByName(last.where("op <> 'delete'").select("path")))


def reconcile(state: DataFrame, rebuilt: DataFrame) -> DataFrame:
    return difference(state, rebuilt)


def run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, seconds: float | None = None, name: str | None = None) -> StreamingQuery:
    """Starts step(batch, id) over a stream. Each consumer has its own query and checkpoint, so one failing leaves others be."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds or DEFAULT.debounce_seconds} seconds")
    return writer.start()
