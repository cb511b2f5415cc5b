"""The catalogue: a generated, grouped and ordered list of all notes, and its incremental upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULT, EngineConfig
from corpus_engine.functions import markdown as md
from corpus_engine.functions import text as tx


def entries(notes: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(path, folder, title, description) of every note that is catalogued."""
    p, text = F.col("path"), F.col("text")
    shown = notes.where(tx.is_note(p) & ~tx.is_protected(p) & ~tx.under_any(p, cfg.catalogue_exclude))
    title = F.coalesce(md.folded_value(text, "title"), md.title_of(text, tx.stem(p)))
    return shown.select("path", tx.folder(p).alias("folder"), title.alias("title"), F.coalesce(md.folded_value(text, "description"), md.first_sentence(text)).alias("description"))


def lines(listed: DataFrame, live_exclusions: tuple[str, ...] = ()) -> DataFrame:
    """(folder_key, kind, place, title_key, path, line): the catalogue's lines with the keys that order them.

    Folders are ordered part by part, not as strings; the root comes first. Within a folder: its heading (kind 0), the
    entries (1), a folder's landing note before the rest, then notices of folders that are left out (2).
    """
    folder_key = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.transform(tx.parts(c), F.lower))
    name = tx.file_name(F.col("folder"))
    landing = F.when((F.lower(tx.stem(F.col("path"))) == F.lower(name)) & (F.col("folder") != ""), 0).otherwise(1)
    line = F.concat(F.lit("- ["), "title", F.lit("]("), tx.percent(F.col("path"), "/'"), F.lit(")"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" - "), "description")).otherwise(""))
    own = listed.select("folder", F.lit(1).alias("kind"), landing.alias("place"), F.lower("title").alias("title_key"), "path", line.alias("line"))
    spark = listed.sparkSession
    left = spark.createDataFrame([(x,) for x in live_exclusions], "x string")
    notice = left.select(tx.folder(F.col("x")).alias("folder"), F.lit(2).alias("kind"), F.lit(0).alias("place"), F.lower("x").alias("title_key"), F.col("x").alias("path"), F.concat(F.lit("> [!NOTE] `"), "x", F.lit("/` is not listed note by note")).alias("line"))
    both = own.unionByName(notice)
    above = both.select("folder").distinct().select(F.explode(F.concat(tx.ancestors(F.col("folder")), F.array("folder"))).alias("folder")).where("folder <> ''").distinct()
    depth = F.least(F.size(tx.parts(F.col("folder"))) + 1, F.lit(6))
    heads = above.select("folder", F.lit(0).alias("kind"), F.lit(0).alias("place"), F.lit("").alias("title_key"), F.lit("").alias("path"), F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), name).alias("line"))
    return both.unionByName(heads).select(folder_key(F.col("folder")).alias("folder_key"), "folder", "kind", "place", "title_key", "path", "line")


ORDER = ("folder_key", "folder", "kind", "place", "title_key", "path")


def rendered(listed: DataFrame, live_exclusions: tuple[str, ...] = ()) -> DataFrame:
    """The lines in order; a distributed sort, written by the caller as one text."""
    return lines(listed, live_exclusions).orderBy(*ORDER)


def placed(listed: DataFrame, live_exclusions: tuple[str, ...] = ()) -> DataFrame:
    """(line_no, line): the catalogue as numbered lines. The numbers come from the counts of folders before, so that no
    task holds more than a folder's lines."""
    rows = lines(listed, live_exclusions)
    sizes = rows.groupBy("folder_key", "folder").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("folder_key", "folder")) - F.col("n")).select("folder", "before")  # a row a folder
    own = F.row_number().over(Window.partitionBy("folder").orderBy("kind", "place", "title_key", "path"))
    return rows.withColumn("own", own).join(before, "folder").select((F.col("before") + F.col("own")).alias("line_no"), "folder", "kind", "line")


def parsed(index: DataFrame) -> DataFrame:
    """(path, title, description) of the entry lines of a stored catalogue (path, text)."""
    line = F.explode_outer(tx.lines(F.col("text"))).alias("x")
    entry = r"^- \[(.*)\]\(([^)\s]*)\)(?: - (.*))?$"
    hit = index.select(line).where(F.col("x").rlike(entry))
    part = lambda n: F.regexp_extract("x", entry, n)
    return hit.select(F.url_decode(F.replace(part(2), F.lit("+"), F.lit("%2B"))).alias("path"), part(1).alias("title"), part(3).alias("description"))


def upsert(old: DataFrame, changed: DataFrame, gone: DataFrame | None = None, key: str = "path") -> DataFrame:
    """old with the rows of changed keys replaced, and those of gone keys removed."""
    keys = changed.select(key) if gone is None else changed.select(key).unionByName(gone.select(key))
    return old.join(keys.distinct(), key, "left_anti").unionByName(changed)


def difference(state: DataFrame, rebuilt: DataFrame, key: str = "path") -> DataFrame:
    """(key, what): missing from the state, extra in it, or changed."""
    a = state.select(key, F.xxhash64(*[c for c in sorted(state.columns) if c != key]).alias("h1"))
    b = rebuilt.select(key, F.xxhash64(*[c for c in sorted(state.columns) if c != key]).alias("h2"))
    what = F.when(F.col("h1").isNull(), "missing").when(F.col("h2").isNull(), "extra").when(F.col("h1") != F.col("h2"), "changed")
    return a.join(b, key, "full_outer").select(key, what.alias("what")).where("what is not null")
