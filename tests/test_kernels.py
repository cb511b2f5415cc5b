import random
import re

import pytest

from corpus_engine.functions import chunking
from corpus_engine.functions import kernels as k
from corpus_engine.functions.stemming import porter2
from corpus_engine.operators import chunks

NOTE = """---
type: note
title: Boiler
tags: [home, heat]
timestamp: 2024-01-01T00:00:00Z
---
# Boiler

intro

## Service

text
### Parts ##

- a
```
# not a heading
```
## Costs
end
"""


def test_headings_and_fences():
    assert [(h.depth, h.text, h.line, h.path) for h in k.headings(NOTE)] == [
        (1, "Boiler", 7, ("Boiler",)), (2, "Service", 11, ("Boiler", "Service")), (3, "Parts", 14, ("Boiler", "Service", "Parts")), (2, "Costs", 20, ("Boiler", "Costs"))]
    assert k.headings("~~~\n# a\n```\n# b\n~~~\n# c") == [k.Heading(1, "c", 6, ("c",))]


def test_heading_keys():
    assert k.heading_key("## **Über** – `x` [a](b) ##") == "über - x a"
    assert k.heading_key("Straße") == k.heading_key("STRASSE")
    assert k.heading_key("so­ft") == "soft"


def test_resolve():
    assert k.resolve(NOTE, "service::parts").line == 14
    with pytest.raises(k.NotFound):
        k.resolve(NOTE, "nothing")
    twice = "# A\n## X\n# B\n## X\n"
    with pytest.raises(k.Refused):
        k.resolve(twice, "X")
    assert k.resolve(twice, "B::X").line == 4
    assert k.resolve("# X\n## X\n", "X").line == 1  # the whole path wins


def test_patch_keeps_one_blank_line():
    once = k.patch(NOTE, "Service::Parts", "append", "\n- b\n\n")
    assert "- a\n```\n# not a heading\n```\n\n- b\n\n## Costs" in once
    assert k.patch(NOTE, "Costs", "replace", "new").endswith("## Costs\n\nnew\n")
    assert k.patch("# A\n\nx\n", "A", "prepend", "p") == "# A\n\np\n\nx\n"
    assert k.patch("# A\nx\n# B\n", "A", "replace", "# C", "marker") == "# C\nx\n# B\n"
    with pytest.raises(k.Refused):
        k.patch(NOTE, "Costs", "erase", "")


def test_fields():
    text = k.set_field(NOTE, "description", "warm: yes")
    assert 'title: Boiler\ndescription: "warm: yes"\ntags:' in text
    assert k.set_field(NOTE, "title", delete=True).count("title") == 0
    assert "thread: \"1548070648281038848\"" in k.set_field(NOTE, "thread", "1548070648281038848")
    assert "timestamp: 2025-02-03T04:05:06Z" in k.set_field(NOTE, "timestamp", "2025-02-03T04:05:06Z")
    assert "expires:\n  - date: 2025-01-01\n    what: bill\n---" in k.set_field(NOTE, "expires", [{"what": "bill", "date": "2025-01-01"}])
    assert "tags: [a, b]" in k.set_field(NOTE, "tags", ["a", "b"])
    for bad in (lambda: k.set_field(NOTE, "x"), lambda: k.set_field("plain\n", "x", "y")):
        with pytest.raises(k.Refused):
            bad()
    assert k.metadata(NOTE) == {"type": "note", "title": "Boiler", "tags": ["home", "heat"], "timestamp": "2024-01-01T00:00:00Z"}
    assert k.metadata("---\na: [1\n---\n") == {}


def test_append_and_normal():
    assert k.append("a\n", "\n\nb\n") == "a\n\nb\n"
    assert k.append("", "b") == "b\n" and k.append("a", "") == "a\n"
    assert k.normal("\ufeffa\r\nb\r\n\n") == "a\nb\n" and k.normal("") == ""


def test_stamps():
    assert "timestamp: 2030-01-02T03:04:05Z\n---" in k.stamped(NOTE, "2030-01-02T03:04:05Z")
    assert k.stamped("no front matter", "2030-01-02T03:04:05Z") == "no front matter\n"


def test_fields_keep_every_other_byte():
    text = "---\n# a comment\ntitle:  'x'   # why\nexpires:\n  - date: 2024-01-01\n    what: y\n\nother:   z\n---\n\n\nbody  \n"
    assert k.set_field(k.set_field(text, "status", "on"), "status", delete=True) == text
    assert k.set_field(text, "expires", delete=True) == text.replace("expires:\n  - date: 2024-01-01\n    what: y\n\n", "")
    assert "title:  'x'   # why\ndescription: d\nexpires:" in k.set_field(text, "description", "d")
    for value in ("plain", "true", "null", "0123", "a: b", "12", "1548070648281038848", "x # y", "'q'", "[a", ""):
        assert k.metadata(k.set_field(text, "v", value))["v"] == value


def test_scopes():
    text = "# A\n\na\n\n## B\n\nb\n\n# C\n"
    assert k.patch(text, "A::B", "replace", "x") == "# A\n\na\n\n## B\n\nx\n\n# C\n"
    assert k.patch(text, "A::B", "replace", "## D\nd", "markerAndContent") == "# A\n\na\n\n## D\nd\n# C\n"
    assert k.patch(text, "C", "append", "c") == text.rstrip() + "\n\nc\n"
    with pytest.raises(k.Refused):
        k.patch(text, "C", "append", "c", "line")


ITEM = "this entry of the log says something about one day at home"


def cut(spark, text):
    return [(r.breadcrumb, r.line, r.text) for r in chunks.note_chunks(spark.createDataFrame([("n.md", text)], "path string, text string")).orderBy("ordinal").collect()]


def test_flat_lists(spark):
    note = "# Log\n" + "\n".join(f"- {ITEM} {i}" for i in range(8)) + "\n"
    assert [(c, line) for c, line, _ in cut(spark, note)] == [("Log", 2 + i) for i in range(8)]
    around = cut(spark, f"# Log\n\nbefore\n\n" + "\n".join(f"* {ITEM} {i}\n  more of {i}" for i in range(12)) + "\n\nafter\nit\n")
    assert [(line, text) for _, line, text in around] == [(3, "before"), *((5 + 2 * i, f"* {ITEM} {i}\n  more of {i}") for i in range(12)), (30, "after\nit")]
    others = [note.replace("- ", "1. "), "# Log\n" + "\n".join(f"- ab {i}" for i in range(8)), "# Log\n" + "\n".join(f"- [{ITEM}](x{i})" for i in range(8)), "# Log\n" + "\n".join(f"- {ITEM}" for _ in range(6))]
    others += ["# Log\n```\n" + "\n".join(f"- {ITEM} {i}" for i in range(8)) + "\n```\n", note.replace(f"- {ITEM} 4\n", f"- {ITEM} 4\n\ntext between\n\n"), note.replace(f"- {ITEM} 4", f"* {ITEM} 4\n1. {ITEM}")]
    for other in others:
        assert len(cut(spark, other)) == 1


def test_short_sections_join_and_lists_stand_alone(spark):
    assert [t for _, _, t in cut(spark, "# A\n\nx\n\n# B\n\ny\n")] == ["# A\n\nx\n\n# B\n\ny"]
    items = "\n".join(f"- {ITEM} {i}" for i in range(8))
    found = cut(spark, f"# Log\n{items}\n\n# Related\n\n[a](b)\n")
    assert len(found) == 8 and found[-1][2] == f"- {ITEM} 7\n\n# Related\n\n[a](b)"
    assert cut(spark, "") == [] and cut(spark, "\n\n") == []


def expected_pieces(body, line, target=1440, least=432, lap=216):
    """The rule for long sections, written as it is told: see which paragraphs a piece holds, then what leads it."""
    spans, at = [], 0
    for part in re.split(r"(\n\n+)", body):
        if part.strip():
            spans.append((at, part))
        at += len(part)
    pieces, open_ = [], []
    for at, p in spans:
        held = sum(len(x) + 2 for _, x in open_)
        if open_ and held + len(p) > target and held >= least:
            pieces.append(open_)
            open_ = []
        open_.append((at, p))
    pieces.append(open_)
    out, before = [], ""
    for piece in pieces:
        own = "\n\n".join(p for _, p in piece)
        lead = before[-lap:]
        if before and len(lead) < len(before) and " " in lead:
            lead = lead[lead.index(" ") + 1 :]
        out.append((line + body[: piece[0][0]].count("\n"), (lead + "\n\n" if lead.strip() else "") + own))
        before = own
    if len(out) > 1 and len(out[-1][1]) < least:
        (n, a), (_, b) = out[-2:]
        out[-2:] = [(n, a + "\n\n" + b)]
    return out


def test_long_sections(spark):
    rng = random.Random(2)
    for n in range(12):
        paragraphs = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([2, 30, 120, 300]))) + "\nline two" * rng.randint(0, 2) for _ in range(rng.randint(2, 14))]
        body = paragraphs[0] + "".join("\n" * rng.randint(2, 5) + p for p in paragraphs[1:])
        assert chunking.packed(body, 7) == expected_pieces(body, 7)
        whole = f"# A\n\n{body}".strip()
        if n < 3:
            want = expected_pieces(whole, 1) if int(len(whole) / 3.6) > 400 else [(1, whole)]
            assert cut(spark, whole + "\n") == [("A", line, text) for line, text in want]


def test_last_short_piece_has_its_overlap():
    body = "a " * 700 + "\n\n" + "tail of it " * 5
    pieces = chunking.packed(body.strip(), 1)
    assert len(pieces) == 1 and pieces[0][1].count("a a a a") > 0 and pieces[0][1].endswith("tail of it")
    assert len(pieces[0][1]) > len(body) + 150  # what leads the short end stands twice


@pytest.mark.parametrize(("word", "stem"), [("consistency", "consist"), ("knightly", "knight"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("electricity", "electr"), ("skies", "sky"), ("news", "news"), ("proceed", "proceed"), ("cries", "cri"), ("ties", "tie"), ("boys", "boy")])
def test_porter2(word, stem):
    assert porter2(word) == stem
