"""Sections to chunks: what is sequential within a note. Sections come from the column functions; no Spark here.

A chunk is (breadcrumb, line, text). Short sections are grouped, long ones cut at paragraphs with an overlap, and a section
that is one flat list of items that each say something is cut by item.
"""

from __future__ import annotations

import re
import statistics
from itertools import groupby
from typing import NamedTuple

from corpus_engine.config import DEFAULT, EngineConfig

# What counts as a list item, a fence, a marker and a link (fixed values).
ITEM = re.compile(r"(?:([-*+])|\d+[.)])\s+\S")
FENCED = re.compile(r"^[^\S\n]{0,3}(```|~~~)[^\n]*(?:\Z|\n.*?(?:^[^\S\n]*\1[^\n]*|\Z))", re.S | re.M)
MARKER = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+", re.M)
LINK = re.compile(r"\[\[[^\]]*\]\]|!?\[[^\]]*\]\([^)]*\)")


class Section(NamedTuple):
    breadcrumb: str
    line: int
    body: str
    heading: bool


def estimate(text: str, cfg: EngineConfig = DEFAULT) -> int:
    return int(len(text) / cfg.chars_per_token)


def is_bare_link(text: str) -> bool:
    """Whether nothing but punctuation is left of a list item without its markers and links."""
    return not LINK.sub("", MARKER.sub("", text)).strip(" \t\r\n-–—:;,.|")


def blocks(body: str) -> list[tuple[int, str, str]]:
    """(line number from 0, kind, text) of a body's blocks at the margin: b a bullet, o an ordered item, t other text.

    A block begins at a line that is neither blank nor indented nor fenced, and that is an item or follows a blank line;
    the first one begins at the first line with anything in it.
    """
    rows = body.split("\n")
    fenced: set[int] = set()  # lines within a fence, the opening one left out
    for m in FENCED.finditer(body):
        first = body.count("\n", 0, m.start(1))
        fenced.update(range(first + 1, first + 1 + m[0].count("\n")))
    full = [i for i, r in enumerate(rows) if r.strip()]
    if not full:
        return []

    def begins(i: int) -> bool:
        if i in fenced or rows[i][0] in " \t":
            return False
        return bool(ITEM.match(rows[i])) or (not rows[i - 1].strip() and i - 1 not in fenced)

    starts = [i for i in full if i == full[0] or begins(i)]
    out = []
    for i, end in zip(starts, [*starts[1:], len(rows)], strict=True):
        item = ITEM.match(rows[i])
        out.append((i, "t" if not item else "b" if item[1] else "o", "\n".join(rows[i:end]).strip()))
    return out


def flat_list(s: Section, cfg: EngineConfig = DEFAULT) -> list[tuple[int, str]] | None:
    """(line, text) of the parts of a section that is one bullet list of items that each say something, else None.

    The kinds of its blocks then read t...tb...bt...t; what stands before and after the list stays whole.
    """
    head = s.body.partition("\n")[0] + "\n" if s.heading else ""
    found = blocks(s.body[len(head) :])
    shape = re.fullmatch("(t*)(b+)(t*)", "".join(kind for _, kind, _ in found))
    if not shape:
        return None
    lo, hi = shape.span(2)
    items = [text for _, _, text in found[lo:hi]]
    enough = len(items) >= max(cfg.flat_list_min_items, cfg.flat_list_ratio * len(found))
    if not enough or statistics.median(estimate(t, cfg) for t in items) < cfg.flat_list_min_item_tokens or sum(map(is_bare_link, items)) >= cfg.flat_list_ratio * len(items):
        return None
    top = s.line + (1 if s.heading else 0)
    around = {part[0][0]: body_of(part) for part in (found[:lo], found[hi:]) if part}
    parts = around | {at: text for at, _, text in found[lo:hi]}
    return [(top + at, text) for at, text in sorted(parts.items())]


def body_of(part: list[tuple[int, str, str]]) -> str:
    """Neighbouring blocks as they stood: blank lines between them are those that their places leave."""
    out, at = "", part[0][0]
    for start, _, text in part:
        out += "\n" * (start - at) + text
        at = start + text.count("\n")
    return out


def grouped(sections: list[Section], cfg: EngineConfig = DEFAULT) -> list[tuple[str, int, str]]:
    """Neighbouring sections joined until they have the least size, under the first one's name; what is left goes to the last group."""
    groups: list[list[Section]] = [[]]
    for s in sections:
        groups[-1].append(s)
        if estimate(joined(groups[-1]), cfg) >= cfg.chunk_min_tokens:
            groups.append([])
    rest = groups.pop()
    if rest and groups:
        groups[-1] += rest
    elif rest:
        groups.append(rest)
    return [(g[0].breadcrumb, g[0].line, joined(g)) for g in groups]


def joined(sections: list[Section]) -> str:
    return "\n\n".join(s.body for s in sections)


def paragraphs(body: str) -> list[tuple[int, str]]:
    """(offset, text) of what stands between empty lines and is not blank."""
    gaps = [m.span() for m in re.finditer(r"\n{2,}", body)]
    spans = zip([0, *(end for _, end in gaps)], [*(start for start, _ in gaps), len(body)], strict=True)
    return [(a, body[a:b]) for a, b in spans if body[a:b].strip()]


def packed(body: str, line: int, cfg: EngineConfig = DEFAULT) -> list[tuple[int, str]]:
    """(line, text) of pieces of a long body: paragraphs up to the target size, each piece led by the end of the one before.

    A piece is closed only where what it holds has the least size. A last piece under it goes to the one before.
    """
    most, least, lap = (int(n * cfg.chars_per_token) for n in (cfg.chunk_target_tokens, cfg.chunk_min_tokens, cfg.chunk_overlap_tokens))
    groups: list[list[tuple[int, str]]] = []
    room = -1  # what the open group can still take before it is closed
    for at, text in paragraphs(body):
        held = most - room
        if not groups or len(text) > room and held >= least:
            groups.append([])
            room = most
        groups[-1].append((at, text))
        room -= len(text) + 2
    bodies = ["\n\n".join(text for _, text in g) for g in groups]
    pieces = [(line + body.count("\n", 0, g[0][0]), lead + own) for g, own, lead in zip(groups, bodies, ["", *(overlap(b, lap) for b in bodies)], strict=False)]
    if len(pieces) > 1 and len(pieces[-1][1]) < least:
        (start, text), (_, last) = pieces[-2:]
        pieces[-2:] = [(start, f"{text}\n\n{last}")]
    return pieces


def overlap(body: str, lap: int) -> str:
    """The end of a piece that leads the next one, from a word's beginning, with the empty line that parts them."""
    tail = body[-lap:] if lap else ""
    if len(tail) < len(body):
        tail = tail.partition(" ")[2] if " " in tail else tail
    return f"{tail}\n\n" if tail.strip() else ""


def chunk(sections: list[Section], cfg: EngineConfig = DEFAULT) -> list[tuple[str, int, str]]:
    """(breadcrumb, line, text) of a note's sections. Flat lists are never joined with what is around them; a short end
    that stands alone after one goes to the chunk before it."""
    out: list[tuple[str, int, str]] = []
    each = [(s, flat_list(s, cfg)) for s in sections]
    for cut, run in groupby(each, lambda x: x[1] is not None):
        if cut:
            new = [(s.breadcrumb, line, text) for s, parts in run for line, text in parts]
        else:
            new = grouped([s for s, _ in run], cfg)
            if out and estimate(new[0][2], cfg) < cfg.chunk_min_tokens:
                crumb, line, text = out[-1]
                out[-1] = (crumb, line, f"{text}\n\n{new.pop(0)[2]}")
        for crumb, line, text in new:
            long = estimate(text, cfg) > cfg.chunk_target_tokens
            out += [(crumb, at, piece) for at, piece in packed(text, line, cfg)] if long else [(crumb, line, text)]
    return out
