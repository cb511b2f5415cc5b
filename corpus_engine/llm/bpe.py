"""Byte-level BPE by per-prefix dynamic programming.

Every prefix of a pretoken has one encoding, and so one last token. An automaton over the vocabulary gives all tokens
that are suffixes of a prefix; the last token is the one whose pair with the last token of the prefix before it is
compatible, that is, stays apart while the merges of both run in rank order. Following the last tokens back from the
end gives exactly the ids of the merge procedure, in time linear in the pretoken, however long it is.

Null text: empty, no ids. Special tokens of the file that occur in a text are single ids, as the tokenizer file says.
Repeated rows each get a row. The file must be plain byte-level BPE: no normaliser,
dropout, byte fallback or ignore_merges, and no added token that takes in white space or whole words only.
"""

from __future__ import annotations

import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpus_engine.llm.common import slices, texts

#: The pattern of byte-level pretokenisers (fixed value); white space is the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries of a worker's caches of pretokens and of pairs; they are emptied when full. Longer pretokens aren't kept.
CACHE, LONGEST_KEPT = 200_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixBpe:
    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("only plain byte-level BPE files are supported")
        if model.get("ignore_merges") or any(t.get(flag) for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("neither ignore_merges nor added tokens that look at what is around them are supported")
        alphabet = byte_alphabet()
        raw = {token: bytes(map(alphabet.__getitem__, token)) for token in model["vocab"]}
        self.bytes_of = {i: raw[token] for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}  # id: rank of the merge that makes it; absent for single bytes
        for n, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = n
            self.halves.setdefault(c, (a, b))
            self.made.setdefault(c, n)
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes] = _Kept(self)
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i not in self.halves and len(raw[token]) == 1 or i in self.halves and self.reachable(i):
                self.automaton.add_word(raw[token].decode("latin-1"), (i, len(raw[token])))
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.apart = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def reachable(self, token: int) -> bool:
        """Whether the merges of the token's own bytes end in the token."""
        a, b = self.halves[token]
        return all(x not in self.halves or self.reachable(x) for x in (a, b)) and self.stay_apart(a, b, self.made[token])

    def stay_apart(self, left: int, right: int, until: int) -> bool:
        """Whether no merge of rank under `until` joins the two tokens' bytes across their border.

        Goes back in time: at each moment `a` ends the left side and `b` begins the right side. They would merge if
        their pair's rank comes before the merge that took `a` away, and not after the one that took `b` away: of
        equal ranks the one further left goes first.
        """
        a, b, took_a, took_b = left, right, until, until
        never = -1
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < took_a and r <= took_b:
                return False
            ra, rb = self.made.get(a, never), self.made.get(b, never)
            if ra == rb == never:
                return True
            if ra > rb:
                took_a, a = ra, self.halves[a][1]
            else:
                took_b, b = rb, self.halves[b][0]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self.stay_apart(left, right, 1 << 60)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - length
                if start == 0:
                    last[end], size[end] = token, length
                else:
                    left = last[start]
                    known = pairs.get(left << 32 | token)
                    if known or known is None and compatible(left, token):
                        last[end], size[end] = token, length
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        ids.reverse()
        return ids

    def encode_packed(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        kept = self.kept
        if not self.apart or not self.apart.search(text):
            return b"".join(map(kept.__getitem__, self.split(text)))
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += map(kept.__getitem__, self.split(text[at : m.start()]))
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        return b"".join([*out, *map(kept.__getitem__, self.split(text[at:]))])

    def decode_packed(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Kept(dict):
    def __init__(self, model: PrefixBpe):
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.model.encode_piece(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


_models: dict[str, PrefixBpe] = {}


def model(key: str, file_text: str) -> PrefixBpe:
    """One model a worker process, kept from task to task."""
    if key not in _models:
        _models.clear()
        _models[key] = PrefixBpe(file_text)
    return _models[key]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, ids, decoded): ids packed as little-endian unsigned 32-bit integers, decoded the text they stand for.

    With keep_text the text itself is returned as well.

    The vocabulary file (a few MB, whatever the input) is read on the driver and broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = model(tokenizer_path, file.value)
        for batch in batches:
            for b in slices(batch):
                ids = [bpe.encode_packed(x or "") for x in b.column(1).to_pylist()]
                columns = {"doc_id": b.column(0), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(map(bpe.decode_packed, ids), pa.string())}
                yield pa.RecordBatch.from_pydict(columns | ({"text": b.column(1)} if keep_text else {}))

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string" + ", text string" * keep_text)
