"""The link graph and its rewriting when notes move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions import markdown as md
from corpus_engine.functions import text as tx


def links(notes: DataFrame) -> DataFrame:
    """(path, ord, raw, target, anchor) of every link; target is root-relative and decoded."""
    each = notes.select("path", F.posexplode_outer(md.link_targets(F.col("text"))).alias("ord", "raw")).where("raw is not null")
    bare = F.substring_index("raw", "#", 1)
    target = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare), "^/+", "")
    anchor = F.when(F.contains("raw", F.lit("#")), F.regexp_extract("raw", "#(.*)$", 1))
    return each.select("path", "ord", "raw", target.alias("target"), anchor.alias("anchor"))


def internal(found: DataFrame) -> DataFrame:
    return found.where(~F.col("raw").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (F.col("target") != ""))


def broken(found: DataFrame, files: DataFrame) -> DataFrame:
    """Internal links whose target is no file; a target names a file with or without its suffix."""
    known = files.select(F.col("path").alias("target")).distinct()
    return internal(found).join(known, "target", "left_anti")


def moved(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """(path, text, rewritten) of notes after moves (source, target): paths renamed, links to them rewritten.

    A link counts in four forms, bare or absolute, encoded or not; it becomes absolute and encoded, its anchor kept.
    Texts are cut at their links; targets are looked up by an equi-join, and only notes with a hit are put together
    again, so that no text is searched once for each move.
    """
    forms = moves.select("target", F.explode(F.array_distinct(F.array("source", F.concat(F.lit("/"), "source"), tx.percent(F.col("source")), F.concat(F.lit("/"), tx.percent(F.col("source")))))).alias("form"))
    each = notes.select("path", F.posexplode_outer(F.regexp_extract_all("text", F.lit(md.LINK_TARGET), F.lit(1))).alias("ord", "raw")).where("raw is not null")
    hit = each.withColumn("form", F.substring_index("raw", "#", 1)).join(forms, "form")
    fresh = F.concat(F.lit("/"), tx.percent(F.col("target")), F.substring("raw", F.char_length("form") + 1, F.char_length("raw")))
    edits = hit.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("ord", fresh.alias("to")))).alias("edits"))
    gaps = F.split("text", md.LINK_TARGET, -1)
    raws = F.regexp_extract_all("text", F.lit(md.LINK_TARGET), F.lit(1))
    with_edits = notes.join(edits, "path", "left").withColumns({"gaps": gaps, "raws": raws})
    put = F.concat(F.get("gaps", F.lit(0)), F.array_join(F.transform("raws", lambda r, i: F.concat(F.lit("]("), F.coalesce(F.try_element_at("edits", i), r), F.lit(")"), F.get("gaps", i + 1))), ""))
    renamed = moves.select(F.col("source").alias("path"), F.col("target").alias("to"))
    out = with_edits.join(renamed, "path", "left")
    return out.select(F.coalesce("to", "path").alias("path"), F.when(F.col("edits").isNull(), F.col("text")).otherwise(put).alias("text"), F.coalesce(F.size("edits"), F.lit(0)).alias("rewritten"))
