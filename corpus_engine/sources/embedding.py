"""Client of an embedding endpoint: batches, answers put in order by their index, retries with backoff."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Statuses after which a request is tried again, beside all from 500 on (fixed values).
AGAIN = (408, 425, 429)


class EmbeddingError(RuntimeError):
    """The endpoint refused, failed for good, or answered something else than asked."""


def post(url: str, body: dict, timeout: float, key: str | None = None) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310  the endpoint is configured
        return json.load(answer)


@dataclass
class EmbeddingClient:
    """Pickles to the workers; send and wait can be replaced in tests."""

    url: str
    model: str
    dims: int
    batch: int = 64
    tries: int = 5
    first_wait: float = 1.0
    longest_wait: float = 30.0
    timeout: float = 60.0
    key: str | None = None
    send: Callable[..., dict] = post
    wait: Callable[[float], None] = time.sleep

    def embed(self, texts: list[str]) -> np.ndarray:
        """A row a text, in their order."""
        parts = [self._batch(texts[at : at + self.batch]) for at in range(0, len(texts), self.batch)]
        return np.concatenate(parts) if parts else np.zeros((0, self.dims), np.float32)

    def _batch(self, texts: list[str]) -> np.ndarray:
        answer = self._answered({"model": self.model, "input": texts})
        rows = sorted(answer["data"], key=lambda r: r["index"])
        if [r["index"] for r in rows] != list(range(len(texts))):
            raise EmbeddingError(f"{len(rows)} vectors for {len(texts)} texts, or not one for each")
        out = np.array([r["embedding"] for r in rows], np.float32)
        if out.shape != (len(texts), self.dims):
            raise EmbeddingError(f"vectors of shape {out.shape}, not {(len(texts), self.dims)}")
        return out

    def _answered(self, body: dict) -> dict:
        pause = self.first_wait
        for n in range(1, self.tries + 1):
            try:
                found = self.send(self.url, body, self.timeout, self.key)
                if not isinstance(found.get("data"), list):
                    raise ValueError("no data in the answer")
                return found
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code not in AGAIN:
                    raise EmbeddingError(f"the endpoint refused: {e.code}") from e
                failed: Exception = e
            except (OSError, ValueError) as e:  # no connection, time out, or no valid answer
                failed = e
            if n < self.tries:
                self.wait(pause)
                pause = min(2 * pause, self.longest_wait)
        raise EmbeddingError(f"no answer after {self.tries} tries: {failed}") from failed
