"""The hybrid ranking as one plan over any number of queries.

Dense and lexical candidates are fused by weighted reciprocal rank; queries that name something nearly unique pin the
chunks that hold all their terms; the rest is diversified under a cap of rows of one path. The greedy diversification
has a closed form, since its penalty depends only on whether a path was used: one window and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULT, EngineConfig
from corpus_engine.operators import batch, lexical
from corpus_engine.operators.vectors import top_n


def rank_candidates(scored: DataFrame, n: int, digits: int = 6) -> DataFrame:
    """(query, chunk, score, rank) of the n best, scores rounded so that order does not hang on the last bits."""
    return top_n(scored.withColumn("score", F.round("score", digits)), n, "chunk")


def fuse(dense: DataFrame, sparse: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(query, chunk, score, pos, dense_rank, sparse_rank): weighted reciprocal ranks, 1 for first in both.

    Ties: dense candidates by their rank first, then lexical ones by theirs.
    """
    d = dense.select("query", "chunk", F.col("rank").alias("dense_rank"))
    s = sparse.select("query", "chunk", F.col("rank").alias("sparse_rank"))
    part = F.coalesce(1.0 / (cfg.rrf_k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(cfg.sparse_weight / (cfg.rrf_k + F.col("sparse_rank")), F.lit(0.0))
    full = d.join(s, ["query", "chunk"], "full_outer").withColumn("score", part / ((1 + cfg.sparse_weight) / (cfg.rrf_k + 1)))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), F.coalesce("dense_rank", F.lit(1 << 30)), "sparse_rank")
    return full.withColumn("pos", F.row_number().over(order))


def lookup_hits(posted: DataFrame | None, queries: DataFrame, sparse: DataFrame, path: Column, cfg: EngineConfig = DEFAULT, stemmed: bool = False, frequency: DataFrame | None = None) -> DataFrame:
    """(query, chunk, pin): lexical candidates that hold every term of a query whose rarest known term is nearly unique.

    The best of each path by lexical rank, at most lookup_max_matches of them, numbered from 1. path is an expression
    over the candidates. Only the candidates' postings are looked at, or none if the candidates have `full`, which says
    whether they hold every term, and the frequencies (term, df) are given.
    """
    rare = lexical.rarest_term(posted, queries, stemmed, frequency).where((F.col("rarest") > 0) & (F.col("rarest") <= cfg.lookup_max_matches)).select("query")
    near = sparse.join(rare, "query", "left_semi")
    told = "full" in sparse.columns
    near = (near.where("full") if told else near).select("query", "chunk", path.alias("path"), F.col("rank").alias("sparse_rank"))
    full = near if told else holding(posted, queries.join(rare, "query", "left_semi"), near, stemmed)
    first = full.withColumn("n", F.row_number().over(Window.partitionBy("query", "path").orderBy("sparse_rank"))).where("n = 1")
    return first.withColumn("pin", F.row_number().over(Window.partitionBy("query").orderBy("sparse_rank"))).where(F.col("pin") <= cfg.lookup_max_matches).select("query", "chunk", "pin")


def holding(posted: DataFrame, queries: DataFrame, near: DataFrame, stemmed: bool) -> DataFrame:
    """Candidates (query, chunk, path, sparse_rank) that hold every term of their query, by their postings."""
    wanted = lexical.query_terms(queries, stemmed=stemmed)
    size = wanted.groupBy("query").agg(F.count("*").alias("terms"))
    held = near.join(wanted, "query").join(posted.select("chunk", "term"), ["chunk", "term"]).groupBy("query", "chunk", "path", "sparse_rank").agg(F.count("*").alias("held"))
    return held.join(size, "query").where("held = terms")


def per_path_cap(k: int, cfg: EngineConfig = DEFAULT) -> int:
    return max(1, -(-k // cfg.path_share))


def diversify(fused: DataFrame, pins: DataFrame, path: Column, k: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(query, chunk, score, path, place): the k results of each query, in order, with their own fused scores."""
    cap = per_path_cap(k, cfg)
    rows = fused.join(pins, ["query", "chunk"], "left").withColumn("path", path).withColumn("pin", F.when(F.col("pin") <= k, F.col("pin")))
    by_path = Window.partitionBy("query", "path")
    occurrence = F.count("pin").over(by_path) + F.row_number().over(Window.partitionBy("query", "path", F.col("pin").isNotNull()).orderBy("pos"))
    tier = F.when(F.col("pin").isNotNull(), 0).when(F.col("occurrence") <= cap, 1).otherwise(2)
    marginal = cfg.mmr_lambda * F.col("score") - (1.0 - cfg.mmr_lambda) * F.when(F.col("occurrence") > 1, 1.0).otherwise(0.0)
    order = Window.partitionBy("query").orderBy("tier", F.coalesce("pin", F.lit(0)), F.when(F.col("tier") == 1, -F.round(marginal, 12)).otherwise(F.lit(0.0)), "pos")
    return rows.withColumn("occurrence", occurrence).withColumn("tier", tier).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "chunk", "score", "path", "place")


def with_paths(candidates: DataFrame, paths: DataFrame) -> DataFrame:
    """Candidates, some dozens a query, with the path of each from (chunk, path): the large side is only probed."""
    return candidates.join(paths.select("chunk", "path"), "chunk")


def candidates(chunks: DataFrame, queries: DataFrame, vocab: DataFrame, cfg: EngineConfig = DEFAULT, stemmed: bool = False) -> DataFrame:
    """(query, chunk, score, full, rank): the lexical candidates straight from the texts; vocab is batch.vocabulary of the chunks.

    Candidates whose score is not positive drop out after the cut, not before.
    """
    return batch.bm25(chunks, queries, cfg.candidates, vocab, cfg, stemmed).where("score > 0")


def search(chunks: DataFrame, queries: DataFrame, dense: DataFrame, k: int | None = None, posted: DataFrame | None = None, cfg: EngineConfig = DEFAULT, stemmed: bool = False, vocab: DataFrame | None = None, sparse: DataFrame | None = None) -> DataFrame:
    """(query, chunk, score, path, place) for queries (query, q) over chunks (chunk, path, text).

    dense is (query, chunk, rank), the dense candidates. Lexical candidates come from the postings of a stored index,
    without them from the texts: vocab and sparse (see candidates) may be given then. Those whose score is not positive
    drop out after the cut to the candidates, not before. Scores have four digits.
    """
    if posted is None:
        vocab = batch.vocabulary(chunks, stemmed).persist() if vocab is None else vocab
        sparse = candidates(chunks, queries, vocab, cfg, stemmed).persist() if sparse is None else sparse  # some dozens a query
    else:
        sparse = rank_candidates(lexical.bm25(chunks, queries, posted, cfg, stemmed), cfg.candidates).where("score > 0")
    pins = lookup_hits(posted, queries, with_paths(sparse, chunks), F.col("path"), cfg, stemmed, vocab)
    found = diversify(with_paths(fuse(dense, sparse, cfg), chunks), pins, F.col("path"), cfg.k(k), cfg)
    return found.withColumn("score", F.round("score", 4))


#: What a search without results says.
NOTHING = "Nothing was found."


def rendered(found: DataFrame) -> DataFrame:
    """(query, rendered): the results of each query as markdown, best first: path and breadcrumb, score and line, text."""
    where = F.concat("path", F.when(F.coalesce("breadcrumb", F.lit("")) != "", F.concat(F.lit(" > "), "breadcrumb")).otherwise(""))
    block = F.concat(F.lit("### "), where, F.lit("\nscore "), F.format_string("%.4f", F.col("score").cast("double")), F.lit(", line "), F.col("line").cast("string"), F.lit("\n\n"), "text")
    each = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))).alias("all"))
    return each.select("query", F.array_join(F.transform("all", lambda x: x["block"]), "\n\n").alias("rendered"))
