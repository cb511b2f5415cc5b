"""The corpus pipeline: five filtering and rewriting stages over documents, each written and read again.

A stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.llm import bpe, decontaminate, langid, secrets, simhash
from corpus_engine.llm.common import P, blob_of, documents, shared_dir, written
from corpus_engine.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least score of an accepted language; a text in a script that was never learned scores about 0.36 with four languages.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages of the labelled ones go: no letter, another script, or a score under LEAST_SCORE.

    A null or empty text has no letter and goes; of rows with one id each is judged by its own text.
    """
    return langid.accepted(docs, LEAST_SCORE).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; of rows equal in id and text one.

    Near copies: 5-word shingle sets with a similarity of 0.8 or more, by the distance of SimHash fingerprints of 128
    bits: all pairs that differ by 25 bits or fewer are linked. Texts without a word are copies of one another. A null id is the largest.
    """
    first = written(simhash.heads(docs), "stage_heads")
    first = first.select(F.col("doc_id").alias(f"{P}kept"), F.col("blob").alias(f"{P}head"), "n")
    own = docs.withColumn(f"{P}blob", blob_of(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(f"{P}kept")) & (F.col(f"{P}blob") == F.col(f"{P}head"))
    kept = own.join(first.hint("merge"), same, "left_semi")
    # rows are unique in a sound table; where some repeat, all but one of each go as well
    repeated = first.where("n > 1").limit(1).count() > 0
    return (kept.dropDuplicates(["doc_id", f"{P}blob"]) if repeated else kept).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; a null text or an item without a text holds none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark in their texts; every document stays. A null text becomes an empty one."""
    found = secrets.scan(docs).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias(f"{P}id"), F.col("blob").alias(f"{P}blob"), F.col("spans").alias(f"{P}spans")).distinct()
    text = F.coalesce("text", F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col(f"{P}id")) & (F.sha2(text.cast("binary"), 256) == F.col(f"{P}blob"))
    clean = F.when(F.col(f"{P}spans").isNull(), text).otherwise(secrets.redact(text, F.col(f"{P}spans")))
    return docs.join(found.hint("merge"), same, "left").withColumn("text", clean).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the packed token ids, their number and whether decoding them gives the text back; a null text has no ids."""
    coded = bpe.encode_decode(docs, tokenizer_path(), keep_text=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secret_redaction),
    ("tokens", tokens),
]

#: SQL can express neither the trained model nor the fingerprints' components; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    docs, folder = documents(spark, sf_dir), f"{shared_dir(spark)}/corpus_engine/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
