"""Lexical index and BM25: tokens, postings, document frequencies, corpus statistics, batch scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULT, EngineConfig

#: The published Snowball English stop list without contractions (fixed values).
STOP_WORDS = tuple(
    "i me my myself we us our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing would should could ought a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very will".split()
)


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case ASCII tokens without stop words, in order, repeats kept, before stemming."""
    return F.filter(raw_tokens(text), lambda t: ~t.isin(*STOP_WORDS))


def stemmer():
    from corpus_engine.functions.stemming import porter2

    @F.pandas_udf("string")
    def stem(s):
        return s.map(porter2)

    return stem


def stem_map(terms: DataFrame) -> DataFrame:
    """(term, stem) of a table of terms: each distinct one is stemmed once, not every token."""
    return terms.select("term").distinct().withColumn("stem", stemmer()("term"))


def postings(chunks: DataFrame, id_col: str = "chunk", text_col: str = "text", stemmed: bool = False) -> DataFrame:
    """(chunk, term, tf): one row for each term of each chunk.

    Stems that are stop words go as well. Terms are counted before they are stemmed, so that the join on the vocabulary
    gets one row for each term of a chunk, not one for each token.
    """
    # stop words go after the explode: there the test is compiled, in an array function it is interpreted
    each = chunks.select(F.col(id_col).alias("chunk"), F.explode_outer(raw_tokens(F.col(text_col))).alias("term")).where(F.col("term").isNotNull() & ~F.col("term").isin(*STOP_WORDS))
    counted = each.groupBy("chunk", "term").agg(F.count("*").alias("tf"))
    if not stemmed:
        return counted
    named = counted.join(stem_map(counted), "term").select("chunk", F.col("stem").alias("term"), "tf").where(~F.col("term").isin(*STOP_WORDS))
    return named.groupBy("chunk", "term").agg(F.sum("tf").alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame, posted: DataFrame, id_col: str = "chunk", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row (n, avgdl, mean_idf): all chunks count, also those without a term."""
    return vocabulary_stats(chunks, posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")))


def vocabulary_stats(chunks: DataFrame, vocab: DataFrame) -> DataFrame:
    """corpus_stats of a vocabulary (term, df, tf)."""
    size = chunks.agg(F.count("*").alias("n"))
    total = vocab.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
    base = size.crossJoin(total).select("n", (F.col("tokens") / F.greatest("n", F.lit(1))).alias("avgdl"))  # of single rows
    # the mean over terms follows from how many terms have each frequency: few rows, whatever the vocabulary
    by_df = vocab.groupBy("df").agg(F.count("*").alias("terms"))
    idf = by_df.crossJoin(F.broadcast(base)).agg((F.sum(raw_idf() * F.col("terms")) / F.sum("terms")).alias("mean_idf"))
    return base.crossJoin(idf)


def raw_idf() -> Column:
    return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def idf_table(posted: DataFrame, stats: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(term, df, idf): a negative idf gives way to epsilon times the mean."""
    return weighed(document_frequency(posted), stats, cfg)


def weighed(frequency: DataFrame, stats: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """idf_table of given frequencies (term, df)."""
    with_stats = frequency.crossJoin(F.broadcast(stats))  # of one row
    return with_stats.select("term", "df", F.when(raw_idf() < 0, F.lit(cfg.bm25_epsilon) * F.col("mean_idf")).otherwise(raw_idf()).alias("idf"))


def query_terms(queries: DataFrame, id_col: str = "query", text_col: str = "q", stemmed: bool = False) -> DataFrame:
    """(query, term, qtf), by the same rules as postings."""
    each = queries.select(F.col(id_col).alias("query"), F.explode_outer(raw_tokens(F.col(text_col))).alias("term")).where(F.col("term").isNotNull() & ~F.col("term").isin(*STOP_WORDS))
    if stemmed:  # the terms of a query are few: no vocabulary is needed
        each = each.select("query", stemmer()("term").alias("term")).where(~F.col("term").isin(*STOP_WORDS))
    return each.groupBy("query", "term").agg(F.count("*").alias("qtf"))


def bm25(chunks: DataFrame, queries: DataFrame, posted: DataFrame | None = None, cfg: EngineConfig = DEFAULT, stemmed: bool = False) -> DataFrame:
    """(query, chunk, score) for chunks (chunk, text) that share a term with a query (query, q).

    Only postings of query terms are scored: they are cut down by a join on the term before chunk lengths are attached.
    """
    posted = postings(chunks, stemmed=stemmed) if posted is None else posted
    stats = corpus_stats(chunks, posted, cfg=cfg)
    wanted = query_terms(queries, stemmed=stemmed)
    weights = wanted.join(idf_table(posted, stats, cfg), "term")
    lengths = posted.groupBy("chunk").agg(F.sum("tf").alias("dl"))
    hit = posted.join(weights, "term").join(lengths, "chunk").crossJoin(F.broadcast(stats.select("avgdl")))
    norm = F.col("tf") + F.lit(cfg.bm25_k1) * (1 - cfg.bm25_b + F.lit(cfg.bm25_b) * F.col("dl") / F.col("avgdl"))
    return hit.groupBy("query", "chunk").agg(F.sum(F.col("qtf") * F.col("idf") * F.col("tf") * (cfg.bm25_k1 + 1) / norm).alias("score"))


def rarest_term(posted: DataFrame | None, queries: DataFrame, stemmed: bool = False, frequency: DataFrame | None = None) -> DataFrame:
    """(query, rarest): the least document frequency of the query's terms that the corpus has, 0 if it has none.

    frequency is (term, df), by default that of the postings.
    """
    found = query_terms(queries, stemmed=stemmed).join(document_frequency(posted) if frequency is None else frequency.select("term", "df"), "term").groupBy("query").agg(F.min("df").alias("rarest"))
    return queries.select("query").join(found, "query", "left").select("query", F.coalesce("rarest", F.lit(0)).alias("rarest"))


def containing(posted: DataFrame, queries: DataFrame, stemmed: bool = False) -> DataFrame:
    """(query, chunk) where the chunk holds every distinct term of the query, unknown ones included."""
    wanted = query_terms(queries, stemmed=stemmed)
    size = wanted.groupBy("query").agg(F.count("*").alias("terms"))
    held = posted.join(wanted, "term").groupBy("query", "chunk").agg(F.count("*").alias("held"))
    return held.join(size, "query").where("held = terms").select("query", "chunk")
