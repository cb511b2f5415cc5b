"""Column builders for markdown structure: front matter, headings, outlines, sections, paragraphs, links, callouts.

All are expressions over one text column, so that structure is found where the row is, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_engine.config import DEFAULT, EngineConfig
from corpus_engine.functions.text import let, lines, newlines, stripped

# Patterns that fix what counts as front matter, a heading, a fence and a link (fixed values).
FRONT = r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*\r?\n?"
HEADING = r"^(#{1,6})\s+(.*?)(?:\s+#+)?\s*$"
FENCED = r"(?msd)^[^\S\n]{0,3}(```|~~~)[^\n]*(?:\z|\n.*?(?:^[^\S\n]{0,3}\1[^\n]*|\z))"
LINK_TARGET = r"\]\(([^)\s]+)\)"
HEADINGS = "array<struct<depth:int,text:string,line:int>>"
PATHS = "array<struct<depth:int,text:string,line:int,path:array<string>>>"


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\uFEFF+", "")


def normal_body(text: Column) -> Column:
    """No byte-order mark, LF line ends and exactly one of them at the end; an empty text stays empty."""
    lf = F.regexp_replace(F.regexp_replace(without_bom(text), "\r\n", "\n"), "\r", "\n")
    return F.when(lf == "", "").otherwise(F.concat(F.regexp_replace(lf, r"\n+\z", ""), F.lit("\n")))


def front_matter(text: Column) -> Column:
    return F.regexp_extract(text, FRONT, 0)


def front_lines(text: Column) -> Column:
    """How many lines the front matter takes."""
    return newlines(front_matter(text))


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, FRONT, ""), r"\A[\r\n]+", "")


def front_bounds(text: Column) -> Column:
    """(start, end) of the lines between the first line `---` and the next, or null."""
    trimmed = F.transform(lines(without_bom(text)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def found(rows):
        closing = F.array_position(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), "---")
        return F.when((F.get(rows, F.lit(0)) == "---") & (closing > 0), F.struct(F.lit(1).alias("start"), closing.cast("int").alias("end")))

    return let(trimmed, found)


def front_block(text: Column) -> Column:
    """The lines of the front matter, or null without one."""
    return let(front_bounds(text), lambda b: F.when(b.isNotNull(), F.slice(lines(without_bom(text)), 2, b["end"] - 1)))


def front_text(text: Column) -> Column:
    """The front matter's lines, each between line ends, or null without one: what keys are looked up in."""
    return F.concat(F.lit("\n"), F.array_join(front_block(text), "\n"), F.lit("\n"))


def _unquoted(c: Column) -> Column:
    c = F.trim(c)
    return F.regexp_replace(c, r"""^(["'])(.*)\1$""", "$2")


def front_values(text: Column, key: str) -> Column:
    """Every scalar of one key as written: inline, flow list or block sequence; null without the key; the first key wins."""
    return let(front_text(text), lambda front: values_of(front, key))


def values_of(front: Column, key: str) -> Column:
    head = rf"\n{key}:([^\n]*)"
    items = F.regexp_extract_all(F.regexp_extract(front, rf"\n{key}:[ \t]*((?:\n\s*- +[^\n]*)*)", 1), F.lit(r"\n\s*- +([^\n]*)"), F.lit(1))

    def parsed(inline):
        flow = F.transform(F.filter(F.split(F.regexp_extract(inline, r"^\[(.*)\]$", 1), ",", -1), lambda x: F.trim(x) != ""), _unquoted)
        return F.when(inline.rlike(r"^\[.*\]$"), flow).when(inline != "", F.array(_unquoted(inline))).otherwise(F.transform(items, _unquoted))

    return F.when(front.rlike(head), let(F.trim(F.regexp_extract(front, head, 1)), parsed))


def folded_value(text: Column, key: str) -> Column:
    """A key's value with indented continuation lines joined by spaces, block-scalar heads and outer quotes dropped."""

    def value(found):
        bare = F.transform(found, lambda v: F.regexp_replace(F.regexp_replace(v, r"^\s*[>|][+-]?[0-9]?[+-]?\s*(?=\n|$)", ""), r"\s*\n\s*", " "))
        joined = F.trim(F.array_join(F.transform(bare, lambda v: stripped(v)), " "))
        return F.when(F.size(found) > 0, F.nullif(F.regexp_replace(joined, r"""^(["'])(.*)\1$""", "$2"), F.lit("")))

    return let(F.regexp_extract_all(front_text(text), F.lit(rf"\n{key}:([^\n]*(?:\n[ \t]+\S[^\n]*)*)"), F.lit(1)), value)


def headings(text: Column) -> Column:
    """ATX headings outside front matter and fences: depth, text and 1-based line.

    The text is cut at its fenced blocks; each part's lines are numbered from the line ends of all that is before it.
    """

    def found(body):
        parts, fenced = F.split(body, FENCED, -1), F.regexp_extract_all(body, F.lit(FENCED), F.lit(0))
        ends = F.transform(parts, lambda p, i: newlines(p) + F.coalesce(newlines(F.get(fenced, i)), F.lit(0)))

        def in_part(p, before):
            def heading(x, k):
                h = F.struct(F.char_length(F.regexp_extract(x, HEADING, 1)).alias("depth"), stripped(F.regexp_extract(x, HEADING, 2)).alias("text"), (before + k + 1).cast("int").alias("line"))
                return F.when(F.startswith(x, F.lit("#")) & x.rlike(HEADING), h)

            return F.array_compact(F.transform(lines(p), heading))

        def of_all(ends):
            return F.flatten(F.transform(parts, lambda p, i: let(front_lines(text) + F.aggregate(F.slice(ends, 1, i), F.lit(0), lambda a, b: a + b), lambda before: in_part(p, before))))

        return let(ends, of_all)

    return let(F.substring(text, F.char_length(front_matter(text)) + 1, F.char_length(text)), found).cast(HEADINGS)


def heading_paths(found: Column, most: int = 6) -> Column:
    """Headings up to a depth, each with the texts of its ancestors and itself."""
    start = F.struct(F.array().cast("array<struct<depth:int,text:string>>").alias("stack"), F.array().cast(PATHS).alias("out"))

    def step(s, h):
        stack = F.concat(F.filter(s["stack"], lambda a: a["depth"] < h["depth"]), F.array(F.struct(h["depth"].alias("depth"), h["text"].alias("text"))))
        own = F.struct(h["depth"].alias("depth"), h["text"].alias("text"), h["line"].alias("line"), F.transform(stack, lambda a: a["text"]).alias("path"))
        return F.struct(stack.alias("stack"), F.concat(s["out"], F.array(own)).alias("out"))

    return F.aggregate(F.filter(found, lambda h: h["depth"] <= most), start, step, lambda s: s["out"])


def outline(found: Column) -> Column:
    return F.transform(heading_paths(found), lambda h: F.array_join(h["path"], "::"))


def section_end(found: Column, line: Column, depth: Column, total: Column) -> Column:
    """The last line of a heading's section: before the next heading that is no deeper."""
    after = F.filter(found, lambda h: (h["line"] > line) & (h["depth"] <= depth))
    return F.coalesce(F.get(after, F.lit(0))["line"] - 1, total)


def section_text(text: Column, found: Column, wanted: Column) -> Column:
    """The first section whose heading is `wanted` in any case, trimmed at its end; null if there is none."""
    key = F.lower(stripped(F.regexp_replace(stripped(wanted), "^#+", "")))

    def body(h):
        def cut(rows):
            last = section_end(found, h["line"], h["depth"], F.size(rows))
            return F.array_join(F.slice(rows, h["line"], last - h["line"] + 1), "\n")

        return F.when(h.isNotNull(), F.concat(F.regexp_replace(let(lines(text), cut), r"(?U)\s+\z", ""), F.lit("\n")))

    return let(F.get(F.filter(found, lambda x: F.lower(x["text"]) == key), F.lit(0)), body)


def sections(text: Column, found: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Heading-scoped spans: breadcrumb, line, body, and whether the body begins with its heading; empty ones dropped."""

    def spans(rows, own):
        total = F.size(rows)

        def span(h, i):
            end = F.coalesce(F.get(own, i + 1)["line"] - 1, total)
            body = stripped(F.array_join(F.slice(rows, h["line"], end - h["line"] + 1), "\n"))
            return F.struct(F.array_join(h["path"], " > ").alias("breadcrumb"), h["line"].alias("line"), body.alias("body"), F.lit(True).alias("heading"))

        front = front_lines(text).cast("int")
        first = F.coalesce(F.get(own, F.lit(0))["line"], total + 1)
        raw = F.array_join(F.slice(rows, front + 1, F.greatest(first - 1 - front, F.lit(0))), "\n")
        blanks = newlines(F.regexp_extract(raw, r"(?U)\A\s*", 0))
        lead = F.struct(F.lit("").alias("breadcrumb"), (front + 1 + blanks).cast("int").alias("line"), stripped(raw).alias("body"), F.lit(False).alias("heading"))
        return F.filter(F.concat(F.array(lead), F.transform(own, span)), lambda s: s["body"] != "")

    return let(F.struct(lines(text).alias("rows"), heading_paths(found, cfg.section_max_depth).alias("own")), lambda x: spans(x["rows"], x["own"]))


def title_of(text: Column, otherwise: Column) -> Column:
    """The first line `# …` after the front matter, or the other."""
    first = F.get(F.filter(lines(without_front_matter(text)), lambda x: x.rlike(r"^#\s+\S")), F.lit(0))
    return F.coalesce(stripped(F.regexp_replace(first, r"^#\s+", "")), otherwise)


def first_sentence(text: Column, most: int = 240) -> Column:
    """The opening sentence of the first line that is plain text."""
    plain = F.filter(F.transform(lines(without_front_matter(text)), stripped), lambda x: (x != "") & ~x.rlike(r"^(#|>|-|\*|\||```|---)"))
    sentence = stripped(F.regexp_extract(F.get(plain, F.lit(0)), r"(?U)\A(.*?)(?:(?<=[.!?])\s.*)?\z", 1))
    return let(sentence, lambda c: F.when(F.char_length(c) > most, F.concat(F.regexp_replace(F.left(c, F.lit(most)), r" [^ ]*\z", ""), F.lit("..."))).otherwise(c))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n{2,}", -1), lambda p: stripped(p) != "")


def token_estimate(c: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return F.floor(F.char_length(c) / F.lit(cfg.chars_per_token)).cast("long")


def link_targets(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINK_TARGET), F.lit(1))


def is_bare_link(item: Column) -> Column:
    """Whether nothing but punctuation is left of a list item without its markers and links."""
    left = F.regexp_replace(F.regexp_replace(item, r"(?m)^\s*([-*+]|\d+[.)])\s+", ""), r"\[\[[^\]]*\]\]|!?\[[^\]]*\]\([^)]*\)", "")
    return F.regexp_replace(left, r"[ \t\r\n\-–—:;,.|]", "") == ""


def embed_text(title: Column, description: Column, breadcrumb: Column, text: Column) -> Column:
    """What is embedded for a chunk: a prefixed head, the breadcrumb if there is one, a blank line, the text."""
    head = F.when(description == "", title).when(title == "", description).otherwise(F.concat(title, F.lit(" - "), description))
    first = F.regexp_replace(F.concat(F.lit("search_document: "), head), r"\s+\z", "")
    return F.concat(first, F.when(breadcrumb != "", F.concat(F.lit("\n"), breadcrumb)).otherwise(""), F.lit("\n\n"), text)


def assembled(pages: Column) -> Column:
    """Pages as one text: joined plainly if any has a heading, else each under a heading with its page number."""
    clean = F.transform(pages, lambda p: stripped(F.coalesce(p, F.lit(""))))

    def put(texts):
        plain = F.array_join(F.filter(texts, lambda p: p != ""), "\n\n")
        numbered = F.filter(F.transform(texts, lambda p, i: F.when(p != "", F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"), p))), lambda p: p.isNotNull())
        return let(plain, lambda j: F.when(j.rlike(r"(?m)^#{1,6}\s+\S"), j).otherwise(F.array_join(numbered, "\n\n")))

    return let(clean, put)
