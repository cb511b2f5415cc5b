"""Column helpers: paths, lines, white space and percent-encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULT, EngineConfig

# White space as Unicode has it; Spark's trim takes spaces only.
SPACE = r"(?U)\s"


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def newlines(c: Column) -> Column:
    return F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))


def parts(path: Column) -> Column:
    return F.split(path, "/", -1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """The path up to its last slash, '' at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """The lower-case suffix with its dot; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def is_protected(path: Column) -> Column:
    return is_hidden(path) | (path == "index.md")


def is_search_excluded(path: Column, cfg: EngineConfig = DEFAULT) -> Column:
    names = F.array(*[F.lit(x) for x in cfg.search_exclude]) if cfg.search_exclude else F.array().cast("array<string>")
    return is_protected(path) | F.arrays_overlap(parts(path), names)


def under_any(path: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a path lies under one of the prefixes, in any case."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(F.lower(path), F.lit(p.strip("/").lower() + "/"))
    return out


def is_document(path: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return suffix(path).isin(*cfg.document_suffixes)


def is_note(path: Column) -> Column:
    return suffix(path) == ".md"


def in_write_scope(path: Column, scope: str | None) -> Column:
    """No scope allows all; a scope that names a note allows that note, any other one what lies under it."""
    if not scope:
        return F.lit(True)
    clean = scope.strip("/")
    return path == clean if clean.endswith(".md") else F.startswith(path, F.lit(clean + "/"))


def normal_path(raw: Column) -> Column:
    """A requested path with leading slashes, '.' and '..' resolved; null if it leaves the root or is not a path."""
    step = F.aggregate(
        F.filter(parts(raw), lambda p: ~p.isin("", ".")),
        F.struct(F.array().cast("array<string>").alias("held"), F.lit(False).alias("out")),
        lambda s, p: F.when(p != "..", F.struct(F.concat(s["held"], F.array(p)).alias("held"), s["out"].alias("out"))).otherwise(
            F.struct(F.slice(s["held"], 1, F.greatest(F.size(s["held"]) - 1, F.lit(0))).alias("held"), (s["out"] | (F.size(s["held"]) == 0)).alias("out"))
        ),
    )
    found = let(step, lambda s: F.when(~s["out"], F.array_join(s["held"], "/")))
    return F.when(raw.isNull() | F.contains(raw, F.lit("\0")), F.lit(None)).otherwise(found)


def percent(path: Column, keep: str = "/") -> Column:
    """Percent-encoding of UTF-8 with unreserved characters and `keep` left as they are."""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((f"%{ord(c):02X}", c) for c in keep)):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ancestors(path: Column) -> Column:
    """All folders above a path, outermost first."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda n: F.array_join(F.slice(p, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
