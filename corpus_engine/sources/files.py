"""Single files written whole: beside their place, then moved there; for exports of notes, documents and the catalogue."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from corpus_engine.functions.kernels import FRONT, normal


def write_bytes(path: str | Path, content: bytes, mode: int = 0o644) -> None:
    """Readers see the old file or the new one. An existing file keeps its mode; folders are made."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    kept = path.stat().st_mode & 0o777 if path.exists() else mode
    handle, beside = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(beside, kept)
        os.replace(beside, path)
    except BaseException:
        Path(beside).unlink(missing_ok=True)
        raise


def write_text(path: str | Path, text: str) -> None:
    """LF line ends and exactly one at the end."""
    write_bytes(path, normal(text).encode())


def write_if_changed(path: str | Path, text: str) -> bool:
    """Writes only where the body, front matter left out, is another one; returns whether it did."""
    path = Path(path)
    body = lambda t: FRONT.sub("", normal(t), count=1)
    if path.exists() and body(path.read_text(encoding="utf-8", errors="replace")) == body(text):
        return False
    write_text(path, text)
    return True


def ocr_available(enabled: bool, data_folder: str | None) -> tuple[bool, str]:
    """Whether scanned pages can be read, and why not: OCR is off, or the folder of its language data is unset or missing."""
    for wrong, why in ((not enabled, "OCR is off"), (not data_folder, "no folder of language data is set"), (bool(data_folder) and not os.path.isdir(data_folder or ""), f"{data_folder} is not a folder")):
        if wrong:
            return False, why
    return True, ""
