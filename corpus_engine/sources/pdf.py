"""The text layer of simple PDF files: pages in order, their content streams, the strings that these show.

Reads classic objects with plain or Flate streams and single-byte strings; fonts with tables of their own are read as
Latin-1. Encrypted files are refused. Anything else an installation registers its own extractor for.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"(.*?)stream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|T\*|'|\"|-?[\d.]+\s+-?[\d.]+\s+T[dD]|-?\d+(?:\.\d+)?|BT|ET", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Encrypted(ValueError):
    """The file cannot be read without a key."""


def literal(raw: bytes) -> str:
    """The characters of a (string) or <hexadecimal string>."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")

    def one(m: re.Match) -> bytes:
        if m[1].isdigit():
            return bytes([int(m[1], 8) & 255])
        return b"" if m[1] in (b"\n", b"\r\n") else ESCAPES.get(m[1], m[1])

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw[1:-1], flags=re.S).decode("latin-1")


def shown(content: bytes) -> str:
    """The text of a content stream; a move to another line or the end of a text block is a line end."""
    out: list[str] = []
    for m in SHOWN.finditer(content):
        token = m[0]
        if token[:1] in b"(<":
            out.append(literal(token))
        elif token in (b"ET", b"T*", b"'", b'"') or token[-2:] in (b"Td", b"TD") and not re.match(rb"-?[\d.]+\s+-?0*\.?0*\s+T", token):
            out.append("\n")
        elif re.fullmatch(rb"-\d+(?:\.\d+)?", token) and float(token) < -200:  # a wide gap within a shown array
            out.append(" ")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(out))).strip()


def pages(file: bytes) -> list[str]:
    """The text of each page, '' where it has none."""
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", file):
        raise Encrypted("the file is encrypted")
    objects = {int(m[1]): m[2] for m in OBJECT.finditer(file)}

    def content(number: int) -> bytes:
        found = STREAM.match(objects.get(number, b""))
        if not found:
            listed = REFERENCE.findall(objects.get(number, b""))
            return b"\n".join(content(int(n)) for n in listed if int(n) != number)
        return zlib.decompressobj().decompress(found[2]) if b"/FlateDecode" in found[1] else found[2]

    def walk(number: int, seen: frozenset[int]) -> list[str]:
        own = objects.get(number, b"")
        if number in seen:
            return []
        if kids := re.search(rb"/Kids\s*\[(.*?)\]", own, re.S):
            return [t for k in REFERENCE.findall(kids[1]) for t in walk(int(k), seen | {number})]
        if not re.search(rb"/Type\s*/Page\b", own):
            return []
        streams = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", own, re.S)
        return [shown(b"\n".join(content(int(n)) for n in REFERENCE.findall(streams[1])) if streams else b"")]

    roots = [int(n) for body in objects.values() if re.search(rb"/Type\s*/Catalog\b", body) for n in re.findall(rb"/Pages\s+(\d+)", body)]
    return walk(roots[0], frozenset()) if roots else []
