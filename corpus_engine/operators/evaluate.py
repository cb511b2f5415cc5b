"""Retrieval evaluation: ranks of expected paths, recall, reciprocal rank, concentration, comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows(results: DataFrame, expected: DataFrame, never: DataFrame | None = None) -> DataFrame:
    """(query, scored, rank, returned, max_per_path, forbidden) of results (query, path, place) for expected (query, path).

    rank is the best place of an expected path, null if none came; a query without expected paths is not scored.
    """
    by_path = results.groupBy("query", "path").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    got = by_path.groupBy("query").agg(F.sum("n").alias("returned"), F.max("n").alias("max_per_path"))
    best = by_path.join(expected.select("query", "path").distinct(), ["query", "path"]).groupBy("query").agg(F.min("place").alias("rank"))
    scored = expected.select("query").distinct().withColumn("scored", F.lit(True))
    out = got.join(scored, "query", "full_outer").join(best, "query", "left")
    if never is None:
        bad = got.select("query", F.lit(0).cast("long").alias("forbidden"))
    else:
        bad = by_path.join(never.select("query", "path").distinct(), ["query", "path"]).groupBy("query").agg(F.count("*").alias("forbidden"))
    out = out.join(bad, "query", "left")
    none = F.lit(0).cast("long")
    return out.select("query", F.coalesce("scored", F.lit(False)).alias("scored"), "rank", F.coalesce("returned", none).alias("returned"), F.coalesce("max_per_path", none).alias("max_per_path"), F.coalesce("forbidden", none).alias("forbidden"))


def summarised(evaluated: DataFrame) -> DataFrame:
    scored, hit = F.col("scored"), F.col("rank").isNotNull()
    n = F.count_if(scored)
    return evaluated.agg(
        n.alias("scored_queries"),
        F.count_if(scored & hit).alias("hits"),
        F.round(F.count_if(scored & hit) / n, 4).alias("recall"),
        F.round(F.sum(F.when(scored & hit, 1.0 / F.col("rank")).when(scored, 0.0)) / n, 4).alias("mrr"),
        F.round(F.avg("max_per_path"), 3).alias("mean_max_per_path"),
        F.max("max_per_path").alias("worst_max_per_path"),
    )


def conditions(embedder: str, queries_sha: str, k: int) -> dict:
    """What two evaluations must share to be compared."""
    return {"embedder": embedder, "queries": queries_sha, "k": k}


def save(evaluated: DataFrame, conditions: dict, folder: str) -> None:
    """An evaluation as a baseline: its rows, and the conditions it was made under."""
    evaluated.write.mode("overwrite").parquet(f"{folder}/rows")
    spark = evaluated.sparkSession
    spark.createDataFrame([(k, str(v)) for k, v in conditions.items()], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{folder}/conditions")


def compared_with(now: DataFrame, conditions: dict, folder: str) -> DataFrame:
    """compared with a saved baseline; every query is `incomparable` if it was made under other conditions."""
    spark = now.sparkSession
    held = {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(f"{folder}/conditions").collect()}
    out = compared(now, spark.read.parquet(f"{folder}/rows"))
    if held == {k: str(v) for k, v in conditions.items()}:
        return out
    return out.withColumn("verdict", F.lit("incomparable"))


def compared(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """(query, before, after, verdict): regression, improvement, new, removed or same, by rank."""
    a, b = baseline.select("query", F.col("rank").alias("before"), F.lit(1).alias("b")), now.select("query", F.col("rank").alias("after"), F.lit(1).alias("a"))
    far = F.lit(1 << 30)
    x, y = F.coalesce("before", far), F.coalesce("after", far)
    verdict = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "removed").when(y > x, "regression").when(y < x, "improvement").otherwise("same")
    return a.join(b, "query", "full_outer").select("query", "before", "after", verdict.alias("verdict"))
