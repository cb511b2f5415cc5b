"""Notes and documents to chunks: sections by column functions, then the sequential part a note at a time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULT, EngineConfig
from corpus_engine.functions import chunking
from corpus_engine.functions import markdown as md
from corpus_engine.functions import text as tx


def _spans(rows: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(path, title, description, ordinal, breadcrumb, line, text) of rows (path, title, description, text)."""

    def run(batches):
        for b in batches:
            path, title, about, found = (c.to_pylist() for c in b.columns)
            out = [(p, t, d, n, *c) for p, t, d, own in zip(path, title, about, found, strict=True) for n, c in enumerate(chunking.chunk([chunking.Section(**s) for s in own or []], cfg))]
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
            names = ["path", "title", "description", "ordinal", "breadcrumb", "line", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    text = F.coalesce("text", F.lit(""))
    cut = rows.select("path", "title", "description", md.sections(text, md.headings(text), cfg).alias("sections"))
    return cut.mapInArrow(run, "path string, title string, description string, ordinal int, breadcrumb string, line int, text string")


def _finished(spans: DataFrame) -> DataFrame:
    chunk = F.concat("path", F.lit("#"), F.lpad(F.col("ordinal").cast("string"), 6, "0"))
    return spans.withColumns({"chunk": chunk, "embed_text": md.embed_text(F.col("title"), F.col("description"), F.col("breadcrumb"), F.col("text"))})


def note_chunks(notes: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks of notes (path, text): title by front matter or file name, description by front matter."""
    text = F.col("text")
    title = F.coalesce(md.folded_value(text, "title"), tx.stem(F.col("path")))
    rows = notes.select("path", title.alias("title"), F.coalesce(md.folded_value(text, "description"), F.lit("")).alias("description"), "text")
    return _finished(_spans(rows, cfg))


def document_chunks(extracted: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks of documents (path, markdown): titled by file name, described by the folder that owns them."""
    folder = tx.folder(F.col("path"))
    own, above = tx.file_name(folder), tx.folder(folder)
    about = F.when((own == cfg.documents_dir) & (above != ""), tx.file_name(above)).otherwise(own)
    rows = extracted.where(tx.stripped(F.coalesce("markdown", F.lit(""))) != "").select("path", tx.stem(F.col("path")).alias("title"), about.alias("description"), F.col("markdown").alias("text"))
    return _finished(_spans(rows, cfg))
