"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of the text). The ledger, tables in the shared folder,
keeps which (blob, rule version) pairs were scanned and what was found; a scan reads only the texts of unseen pairs,
once for each blob, and joins findings back to all paths that hold it. DataFrame operations only.

A match's place comes from the lengths of the gaps between matches, added up by a window over that match list.

Null text: the empty blob, no findings. A null id keeps its row. Repeated rows: each gets its row, the blob is scanned
once. Texts are scanned whole; offsets are code points, end exclusive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_engine.llm.common import erase, shared_dir, written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; those with fewer than `least` characters in `group` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # the same matches as of AKIA[A-Z0-9]+ with 20 characters or more
    Rule("hex", r"[0-9a-f]{24,}"),  # the maximal runs of 24 or more
)
#: Further kinds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE
SPAN = "array<struct<start:long,kind:int,end:long>>"


def rule_version(rules: tuple[Rule, ...]) -> str:
    import hashlib

    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of a table (blob, text); only blobs with findings; spans by start, then kind."""
    text = F.col("text")

    def matches(i: int, rule: Rule) -> Column:
        gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
        found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
        kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
        return F.struct(F.lit(i).alias("kind"), F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), F.transform(found, F.char_length).alias("len"), F.transform(kept, F.char_length).alias("size")).alias("m"), F.lit(rule.least).alias("least"))

    any_of = "|".join(f"(?:{r.pattern})" for r in rules)
    each = (
        texts.select("blob", "text", F.monotonically_increasing_id().alias("row"))  # also keeps the test below the ledger's joins
        .where(text.rlike(any_of))
        .select("blob", "row", F.explode(F.array(*[matches(i, r) for i, r in enumerate(rules)])).alias("r"))
        .select("blob", "row", "r.kind", "r.least", F.posexplode("r.m").alias("at", "m"))
    )
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(Window.partitionBy("blob", "row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    span = F.struct((F.col("end") - F.col("m.len")).cast("long").alias("start"), F.col("kind"), F.col("end").cast("long").alias("end"))
    return each.withColumn("end", end).where(F.col("m.size") >= F.col("least")).groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("spans"))


class BlobLedger:
    """Tables under root: paths/<version> (id, blob), scanned (blob, rules), findings (blob, rules, spans).

    A version's paths are written whole and replace those of an earlier try, so that a commit can be repeated.
    """

    def __init__(self, spark: SparkSession, root: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.root, self.rules, self.version = spark, root.rstrip("/"), rules, rule_version(rules)

    def _read(self, table: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}") if there else self.spark.createDataFrame([], schema)

    def findings(self) -> DataFrame:
        return self._read("findings", f"blob string, rules string, spans {SPAN}").where(F.col("rules") == self.version)

    def paths(self, version: str) -> DataFrame:
        return self._read(f"paths/{quote(version, safe='')}", "doc_id long, blob string")

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, rules string").where(F.col("rules") == self.version)

    def commit(self, docs: DataFrame, version: str, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Records one version of all paths and scans its unseen blobs; returns how many those were."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        blobs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))
        paths = written(blobs.select("doc_id", "blob"), "ledger_paths")
        first = paths.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id")).alias("p")).select("blob", "p.doc_id")
        unseen = written(first.join(self.scanned(), "blob", "left_anti"), "ledger_unseen")
        new = unseen.count()
        if new:
            wanted = unseen.select(F.col("doc_id").alias("u_id"), F.col("blob").alias("u_blob"))
            todo = blobs.join(wanted, F.col("doc_id").eqNullSafe(F.col("u_id")) & (F.col("blob") == F.col("u_blob")), "left_semi")
            find(todo.select("blob", "text"), self.rules).select("blob", F.lit(self.version).alias("rules"), "spans").write.mode("append").parquet(f"{self.root}/findings")
            unseen.select("blob", F.lit(self.version).alias("rules")).write.mode("append").parquet(f"{self.root}/scanned")
        # last: a version is in the ledger only when all its blobs are scanned
        paths.write.mode("overwrite").parquet(f"{self.root}/paths/{quote(version, safe='')}")
        erase(paths, unseen)
        return new

    def report(self, version: str) -> DataFrame:
        """(doc_id, blob, spans) for every path of a version; spans is empty where nothing was found."""
        found = self.findings().select("blob", "spans").dropDuplicates(["blob"])
        return self.paths(version).join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def new_root(spark: SparkSession) -> str:
    """A place for a ledger in the shared folder."""
    return f"{shared_dir(spark)}/corpus_engine/ledger-{uuid.uuid4().hex}"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, root: str | None = None, version: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, spans) of docs, through a ledger at root, by default a new one in the shared folder."""
    ledger = BlobLedger(docs.sparkSession, root or new_root(docs.sparkSession), rules)
    ledger.commit(docs, version, id_col, text_col)
    return ledger.report(version)


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span, overlapping ones as one, replaced by mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        begin = F.greatest(s.start, acc.at)
        gap = F.substring(text, (acc.at + 1).cast("int"), (begin - acc.at).cast("int"))
        fresh = s.start >= acc.at
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(fresh, F.concat(acc.out, gap, F.lit(mark))).otherwise(acc.out).alias("out"))

    done = F.aggregate(spans, start, step)
    tail = F.substring(text, (done["at"] + 1).cast("int"), F.char_length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], tail))
