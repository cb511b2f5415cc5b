"""Paths of single requests, in plain Python: the driver's forms of the column functions in text.py."""

from __future__ import annotations


def normal(raw: str) -> str | None:
    """Leading slashes, '.' and '..' resolved; None if the path leaves the root or holds a null character."""
    held: list[str] = []
    for part in raw.split("/"):
        if part == "..":
            if not held:
                return None
            held.pop()
        elif part not in ("", "."):
            held.append(part)
    return None if "\0" in raw else "/".join(held)


def suffix(path: str) -> str:
    stem, dot, end = path.rpartition("/")[2].rpartition(".")
    return (dot + end).lower() if stem else ""


def protected(path: str) -> bool:
    return path == "index.md" or any(p.startswith(".") for p in path.split("/"))


def in_scope(path: str, scope: str | None) -> bool:
    clean = (scope or "").strip("/")
    return not clean or (path == clean if clean.endswith(".md") else path.startswith(clean + "/"))
