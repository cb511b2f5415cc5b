"""Mutations of a note table: each gives a new table; the old one stays as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULT, EngineConfig
from corpus_engine.functions import kernels
from corpus_engine.functions import markdown as md
from corpus_engine.functions import text as tx
from corpus_engine.operators import links


def set_body(text: Column, content: Column) -> Column:
    """The front matter as it is, then the new body."""
    return F.concat(md.front_matter(text), md.normal_body(content))


def appended(text: Column, content: Column) -> Column:
    """One blank line between the text and an addition that is not empty."""
    body = F.regexp_replace(md.normal_body(text), r"\n+\z", "")
    new = F.regexp_replace(F.regexp_replace(md.normal_body(content), r"\A(?:[ \t]*\n)+", ""), r"(?U)\s+\z", "")
    return md.normal_body(F.when(body == "", new).when(new == "", body).otherwise(F.concat(body, F.lit("\n\n"), new)))


def stamped(text: Column, now: Column) -> Column:
    """The front-matter timestamp set to now, where the note has one."""
    front = md.front_matter(text)
    fresh = F.regexp_replace(front, r"(?m)^timestamp:.*$", F.concat(F.lit("timestamp: "), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return F.concat(fresh, F.substring(text, F.char_length(front) + 1, F.char_length(text)))


def edited(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """notes (path, text) with edits (path, action, target, content, scope, field, value) applied; (path, text, error).

    Actions: patch operations replace, append and prepend at a heading; set and delete of a front-matter field, value
    as JSON. One edit a note; an edit that is refused leaves its note and says why.
    """

    def run(frames):
        import json

        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                try:
                    if r.action in ("set", "delete"):
                        text = kernels.set_field(r.text, r.field, None if r.value is None else json.loads(r.value), r.action == "delete")
                    elif r.action == "extend":
                        text = kernels.append(r.text, r.content or "")
                    else:
                        text = kernels.patch(r.text, r.target, r.action, r.content or "", r.scope or "content")
                    out.append((r.path, text, None))
                except ValueError as e:
                    out.append((r.path, r.text, str(e)))
            yield f.__class__(out, columns=["path", "text", "error"])

    wanted = edits.select("path", "action", "target", "content", "scope", "field", "value")
    done = notes.select("path", "text").join(wanted, "path").mapInPandas(run, "path string, text string, error string")
    rest = notes.select("path", "text", F.lit(None).cast("string").alias("error")).join(wanted.select("path"), "path", "left_anti")
    return rest.unionByName(done)


def written(notes: DataFrame, new: DataFrame, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(notes with the new ones (path, text), refused paths): an existing note is replaced only if overwriting."""
    clash = new.join(notes.select("path"), "path", "left_semi").select("path")
    fresh = new if overwrite else new.join(clash, "path", "left_anti")
    kept = notes.join(new.select("path"), "path", "left_anti") if overwrite else notes
    return kept.unionByName(fresh.select("path", md.normal_body(F.col("text")).alias("text"))), clash if not overwrite else clash.limit(0)


def deleted(notes: DataFrame, gone: DataFrame) -> DataFrame:
    return notes.join(gone.select("path").distinct(), "path", "left_anti")


def moved(notes: DataFrame, moves: DataFrame, scope: str | None = None) -> DataFrame:
    """Notes after moves; a scoped caller may not move, and no move may hit an existing path or change the kind of file."""
    if scope is not None:
        raise kernels.Refused("a scoped caller cannot move notes")
    bad = moves.where(tx.suffix(F.col("source")) != tx.suffix(F.col("target"))).count() + moves.join(notes.select(F.col("path").alias("target")), "target", "left_semi").count()
    if bad:
        raise kernels.Refused(f"{bad} moves hit an existing path or change the kind of file")
    return links.moved(notes, moves)


def uploaded(files: DataFrame, incoming: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(path, status, sha) of incoming documents (path, content) against files (path, sha): filed, unchanged, replaced or refused."""
    new = incoming.select("path", F.sha2("content", 256).alias("sha"), (F.length("content") == 0).alias("hollow"))
    held = files.select("path", F.col("sha").alias("held"))
    wrong = F.col("hollow") | ~tx.is_document(F.col("path"), cfg) | (tx.file_name(tx.folder(F.col("path"))) != cfg.documents_dir)
    status = F.when(wrong, "refused").when(F.col("held").isNull(), "filed").when(F.col("held") == F.col("sha"), "unchanged").otherwise("replaced")
    return new.join(held, "path", "left").select("path", status.alias("status"), "sha")
