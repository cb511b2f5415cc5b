"""Dense vectors: normalisation, hashed embeddings, exact batch search by block matrix products."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULT, EngineConfig
from corpus_engine.operators.lexical import raw_tokens

#: Queries that are held on each executor in one search, with their vectors (4 MB at 1024 dimensions).
QUERY_BLOCK = 1024
#: Vectors that are multiplied at once.
VECTOR_BATCH = 4096


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: (x / n).cast("float"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hashed_entries(texts: DataFrame, dims: int = 256, id_col: str = "chunk", text_col: str = "text") -> DataFrame:
    """(chunk, dim, value): a hashed bag of words, L2-normalised and sparse.

    A token's weight is 1 + ln(count); the first two 32-bit words of its MD5 give a dimension each, the second with
    a minus sign.
    """
    each = texts.select(F.col(id_col).alias("chunk"), F.explode_outer(raw_tokens(F.col(text_col))).alias("token")).where("token is not null")
    counted = each.groupBy("chunk", "token").agg(F.count("*").alias("n"))
    hashed = counted.select("chunk", (1 + F.log("n")).alias("w"), F.md5(F.col("token").cast("binary")).alias("h"))

    def bucket(at: int) -> Column:
        return (F.conv(F.substring("h", at, 8), 16, 10).cast("long") % dims).cast("int")

    pair = F.array(F.struct(bucket(1).alias("dim"), F.col("w").alias("v")), F.struct(bucket(9).alias("dim"), (-F.col("w")).alias("v")))
    summed = hashed.select("chunk", F.explode(pair).alias("e")).groupBy("chunk", F.col("e.dim").alias("dim")).agg(F.sum("e.v").alias("v"))
    size = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("chunk")))
    return summed.withColumn("s", size).select("chunk", "dim", (F.col("v") / F.greatest("s", F.lit(1e-12))).alias("value"))


def densify(entries: DataFrame, dims: int) -> DataFrame:
    """(chunk, embedding) of sparse entries."""
    zero = F.array_repeat(F.lit(0.0), dims)
    held = F.map_from_entries(F.collect_list(F.struct("dim", "value")))
    return entries.groupBy("chunk").agg(held.alias("m")).select("chunk", F.transform(zero, lambda _, i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def embed(texts: DataFrame, embedder: Embedder, dims: int, batch: int = 64, text_col: str = "embed_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """texts with `embedding`, by batches in the workers; the number and width of the rows an embedder returns are checked."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows: list[np.ndarray] = []
            for at in range(0, len(f), batch):
                part = f[text_col].iloc[at : at + batch].tolist()
                v = np.asarray(embedder.embed(part), np.float32)
                if v.shape != (len(part), dims):
                    raise ValueError(f"the embedder returned {v.shape}, not {(len(part), dims)}")
                rows += list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
            yield f.assign(embedding=pd.Series(rows, index=f.index, dtype=object))

    schema = ", ".join(f"{c} {t}" for c, t in texts.dtypes) + ", embedding array<float>"
    return texts.mapInPandas(run, schema)


def embed_misses(chunks: DataFrame, store: DataFrame, embedder: Embedder, dims: int) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, new store rows): each text that the store (text_sha, embedding) lacks is embedded once."""
    keyed = chunks.withColumn("text_sha", F.sha2(F.col("embed_text").cast("binary"), 256))
    missing = keyed.select("text_sha", "embed_text").dropDuplicates(["text_sha"]).join(store, "text_sha", "left_anti")
    new = embed(missing, embedder, dims).select("text_sha", "embedding")
    return keyed.join(store.unionByName(new), "text_sha"), new


def best_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of the k best rows of each column; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    at = np.argsort(-scores[order], axis=0, kind="stable")[:k]
    number = np.broadcast_to(np.arange(scores.shape[1]), at.shape)
    return number.ravel(), order[at.ravel()]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the k best rows of each column; ties go to the smaller id."""
    number, row = best_rows(ids, scores, k)
    return number, ids[row], scores[row, number]


def matrix(vectors, dims: int) -> np.ndarray:
    """Rows of a batch of arrays of all dimensions, or of arrays of structs (dim, value) of those that are not zero."""
    sparse = next((isinstance(v[0], dict) for v in vectors if len(v)), False)
    if not sparse:
        return np.array([v if len(v) else np.zeros(dims) for v in vectors], np.float64).reshape(-1, dims)
    out = np.zeros((len(vectors), dims))
    row = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
    out[row, [e["dim"] for v in vectors for e in v]] = [e["value"] for v in vectors for e in v]
    return out


def dense_topk(vectors: DataFrame, queries: list[tuple[object, list[float]]], k: int, id_col: str = "chunk", vector_col: str = "embedding", query_type: str = "long", id_type: str = "string", digits: int = 6) -> DataFrame:
    """(query, chunk, score, rank) of the k best chunks for each query: exact, by blocks.

    A block of queries goes to all executors; each multiplies one Arrow batch of vectors at a time and passes on k rows
    a query, so what is shuffled is k rows a query and batch, not the scores of all pairs. Ties go to the smaller id.
    vector_col is an array of all dimensions, or an array of structs (dim, value) of those that are not zero.
    """
    out = None
    dims = len(queries[0][1]) if queries else 0
    for lo in range(0, len(queries), QUERY_BLOCK):
        block = queries[lo : lo + QUERY_BLOCK]
        held = vectors.sparkSession.sparkContext.broadcast(([q for q, _ in block], np.array([v for _, v in block], np.float64)))

        def run(frames, held=held):
            import pandas as pd

            names, q = held.value
            for f in frames:
                for at in range(0, len(f), VECTOR_BATCH):
                    part = f.iloc[at : at + VECTOR_BATCH]
                    rows = matrix(part[vector_col], dims)
                    number, ids, scores = _best(part[id_col].to_numpy(), np.round(rows @ q.T, digits), k)
                    yield pd.DataFrame({"query": [names[i] for i in number], "chunk": ids, "score": scores})

        found = vectors.select(id_col, vector_col).where(F.col(vector_col).isNotNull()).mapInPandas(run, f"query {query_type}, chunk {id_type}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query {query_type}, chunk {id_type}, score double, rank int")
    return top_n(out, k, "chunk")


def top_n(scored: DataFrame, n: int, tie: str, by: str = "score", key: str = "query") -> DataFrame:
    """The n best rows of each query; row_number in a filter becomes a per-task limit before the exchange."""
    order = Window.partitionBy(key).orderBy(F.desc(by), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hashed_topk(entries: DataFrame, query_entries: DataFrame, n: int, dims: int, query_type: str = "long", digits: int = 6) -> DataFrame:
    """(query, chunk, score, rank): the same search over hashed vectors (chunk, dim, value); chunks without a token are in no list."""
    asked: dict = {}
    for r in query_entries.toLocalIterator():  # a stated query set
        asked.setdefault(r["chunk"], [0.0] * dims)[r["dim"]] = r["value"]
    rows = entries.groupBy("chunk").agg(F.collect_list(F.struct("dim", "value")).alias("embedding"))
    return dense_topk(rows, sorted(asked.items()), n, query_type=query_type, digits=digits)
