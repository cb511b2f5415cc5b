"""Sources: note folders, extracted documents, and notes derived from the documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULT, EngineConfig
from corpus_engine.functions import markdown as md
from corpus_engine.functions import text as tx
from corpus_engine.sources import pdf


def read_folder(spark: SparkSession, root: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(path, content, size, mtime) of every note and document below root, hidden ones left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.length(F.lit(root.rstrip("/"))) + F.locate(root.rstrip("/"), "path")
    path = F.url_decode(F.replace(F.substr(F.col("path"), base + 1), F.lit("+"), F.lit("%2B")))
    rows = found.select(path.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return rows.where((tx.is_note(F.col("path")) | tx.is_document(F.col("path"), cfg)) & ~tx.is_hidden(F.col("path")))


def note_text(content: Column) -> Column:
    """UTF-8 with undecodable bytes replaced, without a byte-order mark, with LF line ends."""
    return F.regexp_replace(F.regexp_replace(md.without_bom(F.make_valid_utf8(content.cast("string"))), "\r\n", "\n"), "\r", "\n")


def index_walk(files: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """What is searched: notes and documents, in path order, without protected and excluded ones."""
    p = F.col("path")
    return files.where((tx.is_note(p) | tx.is_document(p, cfg)) & ~tx.is_search_excluded(p, cfg)).orderBy("path")


def link_walk(files: DataFrame) -> DataFrame:
    """What links may stand in: all notes that are not hidden, excluded folders too; the suffix in lower case only."""
    return files.where(F.endswith("path", F.lit(".md")) & ~tx.is_hidden(F.col("path"))).orderBy("path")


def list_dir(files: DataFrame) -> DataFrame:
    """(folder, name, path, type, size) of every entry of every folder; entries of hidden names left out.

    One pass: each file names itself and all folders above it.
    """
    seen = files.where(~tx.is_hidden(F.col("path"))).select("path", "size", F.explode(F.concat(tx.ancestors(F.col("path")), F.array("path"))).alias("entry"))
    kind = F.when(F.col("entry") == F.col("path"), "file").otherwise("dir")
    out = seen.select(tx.folder(F.col("entry")).alias("folder"), tx.file_name(F.col("entry")).alias("name"), "entry", kind.alias("type"), F.when(kind == "file", F.col("size")).alias("size"))
    return out.groupBy("folder", "name", F.col("entry").alias("path"), "type").agg(F.max("size").alias("size"))


#: Extractors by suffix: bytes of a document to the texts of its pages. An installation may put its own in their place.
EXTRACTORS: dict[str, Callable[[bytes], list[str]]] = {".pdf": pdf.pages}


def html_markdown(html: Column) -> Column:
    """Headings, list items and paragraphs of an HTML page as markdown text."""
    x = F.regexp_replace(html, r"(?is)<(script|style|head|nav)\b.*?</\1>|<!--.*?-->", "")
    for pattern, to in ((r"(?i)<h1\b[^>]*>", "\n\n# "), (r"(?i)<li\b[^>]*>", "\n- "), (r"(?i)<(p|br|div)\b[^>]*>|</(h1|p|ul|div)>", "\n\n"), (r"<[^>]*>", ""), (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, to)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return tx.stripped(x)


def extraction_status(markdown: Column, pages: Column, encrypted: Column | None = None, cfg: EngineConfig = DEFAULT) -> Column:
    """What became of a document: encrypted, empty, needs_ocr where its pages hold too little text, or extracted."""
    chars = F.char_length(tx.stripped(F.coalesce(markdown, F.lit(""))))
    out = F.when(encrypted, "encrypted") if encrypted is not None else F.when(F.lit(False), "")
    return out.when(pages == 0, "empty").when(chars < pages * cfg.min_chars_per_page, "needs_ocr").otherwise("extracted")


def extract(files: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(path, markdown, pages, status, detail) of documents, by the registered extractors; an error is a status."""
    known = dict(EXTRACTORS)

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                kind = "." + path.rsplit(".", 1)[-1].lower()
                try:
                    rows.append((path, known[kind](bytes(content)), None))
                except KeyError:
                    rows.append((path, [], f"no extractor for {kind}"))
                except pdf.Encrypted:
                    rows.append((path, [], "encrypted"))
                except Exception as e:  # noqa: BLE001  an unreadable document is a row, not a failed job
                    rows.append((path, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_texts", "detail"])

    found = files.where(tx.is_document(F.col("path"), cfg)).select("path", "content").mapInPandas(run, "path string, page_texts array<string>, detail string")
    markdown, pages = md.assembled(F.col("page_texts")), F.size("page_texts")
    status = F.when(F.col("detail") == "encrypted", "encrypted").when(F.col("detail").isNotNull(), "failed").otherwise(extraction_status(markdown, pages, cfg=cfg))
    return found.select("path", markdown.alias("markdown"), pages.alias("pages"), status.alias("status"), "detail")


def searchable(markdown: Column) -> Column:
    return tx.stripped(F.coalesce(markdown, F.lit(""))) != ""


def read_any(notes: DataFrame, extracted: DataFrame) -> DataFrame:
    """(path, text, kind) of notes (path, text) and of the documents whose extraction gave text."""
    own = notes.select("path", "text", F.lit("note").alias("kind"))
    return own.unionByName(extracted.where(searchable(F.col("markdown"))).select("path", F.col("markdown").alias("text"), F.lit("document").alias("kind")))


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """(q, arm, expect, never, why) of a JSON list or of an object with `queries`; missing fields have defaults."""
    schema = "q string, arm string, expect array<string>, never array<string>, why string"
    row = f"struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>"
    raw = spark.read.text(path, wholetext=True)
    each = raw.select(F.explode(F.coalesce(F.from_json("value", f"struct<queries:array<{row}>>")["queries"], F.from_json("value", f"array<{row}>"))).alias("r")).select("r.*")
    none = F.array().cast("array<string>")
    return each.select("q", F.coalesce("arm", F.lit("either")).alias("arm"), F.coalesce("expect", none).alias("expect"), F.coalesce("never", none).alias("never"), "why")


def derived_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text, size): the documents table as markdown notes with front matter, headings, lists and fences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("lang", F.lit("xx")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    top = "CASE source WHEN 'src1' THEN '.drafts' WHEN 'src2' THEN 'Reports' WHEN 'src3' THEN 'Workflows' ELSE source END"
    path = f"concat({top}, '/', lang, '/doc-', doc_id, '.md')"
    tags = r"CASE WHEN doc_id % 5 = 1 THEN concat('tags:\n  - ', lang, '\n  - \"', source, '\"\n') ELSE concat('tags: [', lang, ', ', source, ']\n') END"
    about = r"CASE WHEN doc_id % 5 = 2 THEN concat('description: >-\n  ', lang, ' text\n  from ', source, '\n') ELSE concat('description: ', lang, ' text from ', source, '\n') END"
    front = rf"CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('---\ntype: note\ntitle: \'Doc ', doc_id, '\'\n', {about}, {tags}, 'timestamp: 2024-01-01T00:00:00Z\n---\n') END"
    line = r"CASE WHEN i % 11 = 10 THEN concat('```\n# ', x, '\n```') WHEN i % 14 = 0 THEN concat('## ', x) WHEN i % 7 = 0 THEN concat('### ', x) WHEN i % 3 = 0 THEN concat('- ', x) ELSE concat(x, '\n') END"
    body = rf"concat(array_join(transform(split(text, '\n', -1), (x, i) -> {line}), '\n'), '\n')"
    out = docs.select("doc_id", F.expr(path).alias("path"), F.expr(f"concat({front}, {body})").alias("text"))
    return out.withColumn("size", F.octet_length("text").cast("long"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, html) of the pages table as filed documents."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.format_string("Files/page-%d.pdf", "page_id").alias("path"), "html", "page_id")
