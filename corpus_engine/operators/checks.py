"""Corpus quality checks: each a table of findings (check, path, detail, severity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULT, EngineConfig
from corpus_engine.functions import markdown as md
from corpus_engine.functions import text as tx
from corpus_engine.operators import catalogue
from corpus_engine.operators import links as lk

# Required keys and callout types (fixed values).
REQUIRED = ("type", "title", "description", "tags", "timestamp")
CALLOUT_TYPES = ("NOTE", "TIP", "IMPORTANT", "WARNING", "CAUTION")


def finding(df: DataFrame, check: str, detail: Column, severity: Column | str = "error") -> DataFrame:
    return df.select(F.lit(check).alias("check"), "path", detail.alias("detail"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"))


def broken_links(notes: DataFrame, files: DataFrame) -> DataFrame:
    return finding(lk.broken(lk.links(notes), files), "links", F.col("raw"))


def catalogue_drift(notes: DataFrame, shown: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """shown is (path, title, description) as the stored catalogue has it."""
    form = lambda df: df.select("path", "title", F.coalesce("description", F.lit("")).alias("description"))
    return finding(catalogue.difference(form(shown), form(catalogue.entries(notes, cfg))), "catalogue", F.col("what"))


def front_matter(notes: DataFrame) -> DataFrame:
    """Notes without front matter, with required keys missing, or with a title, type or timestamp that can't be one."""

    def wrong(front):
        absent = F.array_compact(F.array(*[F.when(~front.rlike(rf"\n{k}:"), F.lit(k)) for k in REQUIRED]))
        shape = {"type": r"[^\n]*\S[^\n]*", "title": r"[^\n]*\S[^\n]*", "timestamp": r"""[ \t]*["']?\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z["']?[ \t]*"""}
        bad = F.array_compact(F.array(*[F.when(front.rlike(rf"\n{k}:") & ~front.rlike(rf"\n{k}:{v}\n"), F.lit(k)) for k, v in shape.items()]))
        said = F.array_compact(F.array(*[F.when(F.size(x) > 0, F.concat(F.lit(word), F.array_join(x, ", "))) for word, x in (("missing ", absent), ("malformed ", bad))]))
        return F.when(front.isNull(), "no front matter").when(F.size(said) > 0, F.array_join(said, "; "))

    return finding(notes.withColumn("bad", tx.let(md.front_text(F.col("text")), wrong)).where("bad is not null"), "front_matter", F.col("bad"))


def hygiene(notes: DataFrame) -> DataFrame:
    """Mixed line ends and paths that differ in case only are errors; a byte-order mark or no final newline warnings."""
    t = F.col("text")
    flags = F.array_compact(F.array(
        F.when(t.rlike("\r\n") & t.rlike("(^|[^\r])\n"), F.struct(F.lit("mixed line ends").alias("d"), F.lit("error").alias("s"))),
        F.when(F.startswith(t, F.lit("\ufeff")), F.struct(F.lit("byte-order mark").alias("d"), F.lit("warning").alias("s"))),
        F.when((t != "") & ~F.endswith(t, F.lit("\n")), F.struct(F.lit("no final newline").alias("d"), F.lit("warning").alias("s"))),
    ))
    own = finding(notes.select("path", F.explode(flags).alias("f")), "hygiene", F.col("f.d"), F.col("f.s"))
    same = notes.groupBy(F.lower("path").alias("key")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1")
    return own.unionByName(finding(same, "hygiene", F.lit("paths differ in case only")))


def series(notes: DataFrame, period_days: int = 1, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Generated series: empty notes, and gaps in series whose names carry dates."""
    own = notes.where(tx.under_any(F.col("path"), cfg.catalogue_exclude))
    empty = finding(own.where(tx.stripped(md.without_front_matter(F.col("text"))) == ""), "series", F.lit("empty"))
    return empty.unionByName(series_gaps(own.select("path", tx.folder(F.col("path")).alias("series"), F.try_to_date(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1)).alias("day")), period_days))


def series_gaps(dated: DataFrame, period_days: int = 1) -> DataFrame:
    """Gaps longer than the period between neighbours of (series, path, day)."""
    before = F.lag("day").over(Window.partitionBy("series").orderBy("day", "path"))
    gap = F.datediff("day", before)
    return finding(dated.where("day is not null").withColumn("gap", gap).where(F.col("gap") > period_days), "series", F.concat(F.lit("gap of "), F.col("gap").cast("string"), F.lit(" days")))


def expiries(notes: DataFrame, today: str, window_days: int = 30) -> DataFrame:
    """Dates of the key `expires`: lapsed or malformed ones are errors, those within the window warnings."""
    raw = F.filter(F.coalesce(md.front_values(F.col("text"), "expires"), F.array().cast("array<string>")), lambda v: v != "none")
    each = notes.select("path", F.explode_outer(raw).alias("v")).where("v is not null").withColumn("day", F.try_to_date(F.regexp_replace("v", "^date: *", ""), "yyyy-MM-dd"))
    left = F.datediff("day", F.to_date(F.lit(today)))
    what = F.when(F.col("day").isNull(), "malformed").when(left < 0, "lapsed").when(left <= window_days, "soon")
    return finding(each.withColumn("what", what).where("what is not null"), "expiries", F.concat("what", F.lit(": "), "v"), F.when(F.col("what") == "soon", "warning").otherwise("error"))


def duplicate_headings(notes: DataFrame) -> DataFrame:
    """Heading paths of a note that can't be told apart by the key that headings are looked up with."""
    from corpus_engine.functions.kernels import heading_key

    @F.pandas_udf("string")
    def keys(paths):
        return paths.map(lambda p: "\0".join(map(heading_key, p.split("\0"))))

    found = F.transform(md.heading_paths(md.headings(F.col("text"))), lambda h: h["path"])
    each = notes.select("path", F.explode_outer(found).alias("h")).where("h is not null").select("path", F.array_join("h", "::").alias("shown"), keys(F.array_join("h", "\0")).alias("key"))
    same = each.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("shown").alias("shown")).where("n > 1")
    return finding(same, "headings", F.col("shown"))


def documents(files: DataFrame, notes: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """files is (path, status). Documents that no note links to or that have no text are errors, stray ones warnings."""
    own = files.where(tx.is_document(F.col("path"), cfg))
    linked = lk.internal(lk.links(notes)).select(F.col("target").alias("path")).distinct()
    orphan = finding(own.join(linked, "path", "left_anti"), "documents", F.lit("orphan"))
    silent = finding(own.where("status <> 'extracted'"), "documents", F.col("status"))
    stray = finding(own.where(tx.file_name(tx.folder(F.col("path"))) != cfg.documents_dir), "documents", F.lit("outside the documents folder"), "warning")
    return orphan.unionByName(silent).unionByName(stray)


def callouts(notes: DataFrame) -> DataFrame:
    """(path, line, type, title, body) of every quoted block; type is null where it has none."""
    rows = notes.select("path", F.posexplode(tx.lines(F.col("text"))).alias("at", "x")).where(F.startswith("x", F.lit(">")))
    group = F.col("at") - F.row_number().over(Window.partitionBy("path").orderBy("at"))
    blocks = rows.withColumn("g", group).groupBy("path", "g").agg(F.array_sort(F.collect_list(F.struct("at", F.regexp_replace("x", "^> ?", "").alias("x")))).alias("rows"))
    head = F.get("rows", F.lit(0))
    kind = F.regexp_extract(head["x"], r"^\[!([^\]]*)\]", 1)
    body = F.array_join(F.transform(F.slice("rows", 2, F.size("rows")), lambda r: r["x"]), "\n")
    return blocks.select("path", (head["at"] + 1).alias("line"), F.nullif(kind, F.lit("")).alias("type"), tx.stripped(F.regexp_replace(head["x"], r"^\[![^\]]*\]", "")).alias("title"), body.alias("body"))


def callout_findings(notes: DataFrame) -> DataFrame:
    t = F.col("type")
    what = F.when(t.isNull(), "untyped").when(~F.upper(t).isin(*CALLOUT_TYPES), "unknown type").when(t != F.upper(t), "wrong case").when(F.col("title") == "", "no title")
    rows = callouts(notes).withColumn("what", what).where("what is not null")
    return finding(rows, "callouts", F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), "what"), F.when(F.col("what").isin("wrong case", "no title"), "warning").otherwise("error"))


def all_checks(notes: DataFrame, files: DataFrame, shown: DataFrame, today: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Findings of the nine checks, in their order, on notes (path, text), documents (path, status) and the stored catalogue
    (path, title, description); a check that cannot be planned is itself a finding, and the others still run."""
    steps = {
        "links": lambda: broken_links(notes, notes.select("path").unionByName(files.select("path"))),
        "catalogue": lambda: catalogue_drift(notes, shown, cfg),
        "front_matter": lambda: front_matter(notes),
        "hygiene": lambda: hygiene(notes),
        "series": lambda: series(notes, cfg=cfg),
        "expiries": lambda: expiries(notes, today),
        "headings": lambda: duplicate_headings(notes),
        "documents": lambda: documents(files.select("path", "status"), notes, cfg),
        "callouts": lambda: callout_findings(notes),
    }
    out = None
    for name, step in steps.items():
        try:
            found = step()
        except Exception as e:  # noqa: BLE001  the other checks still run
            found = notes.sparkSession.createDataFrame([(name, "", f"could not run: {e}", "error")], "check string, path string, detail string, severity string")
        out = found if out is None else out.unionByName(found)
    return out


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.countDistinct("path").alias("notes"))
