"""The registered queries of this subpackage: thin opN_<name> views of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.llm.common import documents
from corpus_engine.llm.oracles import ORACLES as SQL

TOKENIZER = "byte_bpe_50k.json"
#: Likeness of fingerprints under which op6 prunes.
LEAST_LIKENESS = 0.05


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crawls of the same documents: the second finds all (blob, rules) pairs of the first in the ledger and scans nothing."""
    from corpus_engine.llm.secrets import BASE, BlobLedger, joined, new_root

    docs, ledger = documents(spark, sf_dir), BlobLedger(spark, new_root(spark))
    ledger.commit(docs, "first")
    ledger.commit(docs, "second")
    found = ledger.report("second")
    base = F.filter("spans", lambda s: s.kind < len(BASE))

    def count(kind: int, name: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{name}")

    return found.select("doc_id", *[count(i, r.kind) for i, r in enumerate(BASE)], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_engine.llm.bpe import encode_decode

    coded = encode_decode(documents(spark, sf_dir), tokenizer_path())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_engine.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), threshold=4, width=4).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_engine.llm.licenses import scan

    return scan(documents(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_engine.llm.langid import fit, held_out, predict

    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of the text with its second half replaced by the start of the next document.

    Pairs are compared pruned: a likeness under LEAST_LIKENESS is not worked out and given as 0.
    """
    import pyarrow as pa

    from corpus_engine.llm.spotsigs import jaccard, signatures, text_form, with_next

    def each(ids, own, following):
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(own, following, strict=True)]
        sets = [signatures(x) for x in own] + [signatures(x) for x in following[-1:]]
        changed = [signatures(x) for x in edited]
        columns = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_chars": pa.array(map(len, own), pa.int64()),
            "edited": pa.array(edited, pa.string()),
            "fingerprint": pa.array(map(text_form, sets[:-1]), pa.string()),
            "edited_fingerprint": pa.array(map(text_form, changed), pa.string()),
            "near_edited": pa.array([jaccard(a, b, LEAST_LIKENESS) for a, b in zip(sets, changed, strict=False)], pa.float64()),
            "near_next": pa.array([jaccard(a, b, LEAST_LIKENESS) for a, b in zip(sets, sets[1:], strict=False)], pa.float64()),
        }
        return pa.table(columns)

    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    found = with_next(documents(spark, sf_dir), schema, each)
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_engine.llm.substrings import remove_repeats

    cut = remove_repeats(documents(spark, sf_dir), width=13)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return cut.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_runindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_engine.llm.runindex import remove_repeats

    cut = remove_repeats(documents(spark, sf_dir), length=200)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return cut.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_engine.llm.decontaminate import contaminated

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_engine.llm.sharding import shard

    placed = shard(documents(spark, sf_dir).select("doc_id", "text"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_licenses": op4_licenses,
    "op5_language": op5_language,
    "op6_spotsigs": op6_spotsigs,
    "op7_substrings": op7_substrings,
    "op8_runindex": op8_runindex,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = SQL
