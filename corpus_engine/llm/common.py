"""Helpers shared by the training-data operators: inputs, written tables and size-bounded work units."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every internal column, so that extra columns of an input cannot clash with ours.
P = "_ce_"
#: The largest id; a null id counts as it where ids are put in order.
LAST = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text) of an input, null texts as empty ones; extra columns are dropped here."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def blob_of(text: Column) -> Column:
    """SHA-256 of a text, null as empty: beside the id it tells rows apart whose ids are null or repeated."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Where that is unset a local session gets a temporary folder of its own; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpus_engine_")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives the loss of an executor. See erase.

    narrow: for tables of few and short rows behind an exchange: a file for each core at most, not one for each
    partition, since every open Parquet file takes memory outside the heap.
    """
    spark = df.sparkSession
    df = df.coalesce(spark.sparkContext.defaultParallelism) if narrow else df
    path = f"{shared_dir(spark)}/corpus_engine/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ce_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def erase(*tables: DataFrame) -> None:
    """Deletes tables made by written that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._ce_path)


def release(spark: SparkSession) -> None:
    """Deletes all tables of this library in the shared folder; results not yet read are lost."""
    _delete(spark, f"{shared_dir(spark)}/corpus_engine")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batch, rows: int = 256, most: int = 8 << 20):
    """Small parts of an Arrow batch: up to `rows` rows and about `most` bytes of text, or one row that is longer."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and (held + n > most or i - start == rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def cell_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters that are at most key: a binary search of log2(n) steps in one array literal."""
    if not splitters:
        return F.lit(0)
    top = 1 << len(splitters).bit_length() - 1
    cuts = F.split(F.lit(",".join(map(str, splitters))), ",").cast("array<bigint>")  # folded to a literal by the optimiser

    def search(k):
        def step(at, half):
            return F.when(F.get(cuts, at + half - 1) <= k, at + half).otherwise(at)

        return F.aggregate(F.array(*[F.lit(top >> i) for i in range(top.bit_length())]), F.lit(0), step)

    return F.get(F.transform(F.array(key), search), F.lit(0))  # the key is evaluated once


def one_of(value: Column, sorted_values: list[int]) -> Column:
    """Whether value is among them, by the same search."""
    held = F.split(F.lit(",".join(map(str, sorted_values))), ",").cast("array<bigint>")
    return F.coalesce(F.get(held, cell_of(value, sorted_values) - 1) == value, F.lit(False))


def bundled(docs: DataFrame, target_bytes: int = 6 << 20) -> tuple[DataFrame, int, list[int]]:
    """(bundle, doc_id, text): ranges of doc_id of about target_bytes of text each, in id order.

    Returns also the number of bundles and their splitters. A null doc_id counts as the largest.
    Equal ids share a bundle; a bundle is one unit of Python work and bounds its memory. The splitters, 8 bytes for
    target_bytes of text, are broadcast once to each executor.
    """
    from corpus_engine.llm.sharding import histogram_splitters

    key = F.shiftright(F.coalesce(F.col("doc_id"), F.lit(LAST)), 1)  # half of the range, so that no difference overflows
    sizes = written(docs.select(key.alias("k"), (F.octet_length("text") + F.lit(64)).cast("long").alias("w")), "sizes")
    total = sizes.agg(F.sum("w")).first()[0] or 0
    n = max(1, -(-int(total) // target_bytes))
    cuts = histogram_splitters(sizes, n, tolerance=0.25)[0] if n > 1 else []
    held = docs.sparkSession.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def find(ids):
        return ids.__class__(np.searchsorted(held.value, ids.to_numpy(dtype=np.int64), side="right").astype(np.int32))

    return docs.select(find(key).alias("bundle"), "doc_id", "text"), n, cuts
