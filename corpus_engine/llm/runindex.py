"""Exact dedup of long byte strings with run-length compressed Burrows-Wheeler indexes.

A string of `length` bytes is repeated if it starts anywhere else in the corpus; every byte under a repeated string goes.
One index over a corpus can't be dealt out, so strings are first brought together by content. The anchor of a string
is its 16-gram of least hash; equal strings have equal anchors. Consecutive strings with one anchor form a piece.

1. Every bundle of documents (a range of ids) gives (anchor, 96-bit hash of piece), each distinct pair once.
2. Spark counts pairs, and different pieces of each anchor, both summed before they are shuffled, so that no anchor's pieces
   meet in one task. A piece that stands twice is repeated as a whole. If pieces of one anchor differ and one of them stands
   only once, one copy of each different piece is asked for: runs of equal copies never enter an index twice.
3. Per part of the anchors the asked pieces are indexed: suffixes sorted by prefix doubling, their Burrows-Wheeler
   transform cut into runs, and the suffix positions and match lengths kept at run ends only. Within a run a match
   is one byte shorter at each next byte, so matching statistics of all pieces are streamed from the samples alone.
   Strings whose statistic reaches `length` are repeated.
4. Each bundle puts the answers together and removes the bytes.

An anchor with more than `crowd` different pieces would make one part unboundedly large; hashes of its strings, of 127
bits, are dealt over all parts and counted instead. Null or short texts: nothing is removed. Rows of equal doc_id, as all
others, count against each other: repeated rows are repeated strings. Matches never cross documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import as_bytes, bundled, erase, texts, written
from corpus_engine.llm.substrings import BASE_2, mixed, part_bounds, rolling

GRAM = 16
PLACE = np.uint64((1 << 30) - 1)
#: Strings whose anchors are looked for at once.
STEP = 1 << 18
#: Different pieces of one anchor up to which they share an index.
CROWD = 2048
#: What is answered for a piece: it stands twice; send its bytes; send the hashes of its strings.
TWICE, BYTES, HASHES = 1, 2, 4


class Anchored:
    """A bundle's documents as bytes, with the pieces of all their strings of `length` bytes."""

    def __init__(self, ids: list, data: list[bytes], length: int):
        self.ids, self.data, self.length = ids, data, length
        sizes = np.array([len(x) for x in data], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.buffer = b"".join(data)
        w = length - GRAM + 1
        starts = len(self.buffer) - length + 1
        empty = np.empty(0, np.int64)
        self.first, self.last, self.anchor = empty, empty, empty.astype(np.uint64)
        self.place = empty
        if starts > 0:
            least = np.concatenate([self._least(lo, min(lo + STEP, starts), w) for lo in range(0, starts, STEP)])
            valid = np.zeros(starts + 1, bool)
            for a, b in zip(self.start[:-1], self.start[1:], strict=True):
                valid[a : max(a, b - length + 1)] = True
            valid = valid[:starts]
            new = np.concatenate([[True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])])
            new[np.minimum(self.start[:-1], starts - 1)] = True
            edge = np.flatnonzero(new)
            ends = np.concatenate([edge[1:], [starts]]) - 1
            ok = valid[edge]
            self.first, self.last = edge[ok], ends[ok]
            self.place = least[self.first]
            self.anchor = mixed(~self._grams(self.place) * np.uint64(0xA0761D6478BD642F))  # least hashes are all small: spread them
        digest, buf = xxhash.xxh3_128_digest, self.buffer
        whole = b"".join(digest(buf[a : b + length], p - a) for a, b, p in zip(self.first.tolist(), self.last.tolist(), self.place.tolist(), strict=True))
        high, low = np.frombuffer(whole, "<u8").reshape(-1, 2).T
        order = np.lexsort((low, high, self.anchor))
        a, c, d = self.anchor[order], high[order], low[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])])[: len(a)]
        at = np.flatnonzero(new)
        self.keys, self.pieces = a[at], np.stack([c[at], d[at]])  # distinct pairs, sorted: the same in every run
        self.one = order[at]  # a piece of each
        self.twice = np.diff(np.concatenate([at, [len(a)]])) > 1
        self.which = np.empty(len(a), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def _grams(self, at) -> np.ndarray:
        """Hashes of the grams at a slice of places or at given ones."""
        eight = np.ndarray((len(self.buffer) - 7,), "<u8", self.buffer, strides=(1,))
        if isinstance(at, slice):
            one, two = eight[at], eight[at.start + 8 : at.stop + 8]
        else:
            one, two = eight[at], eight[at + 8]
        return mixed(one * np.uint64(0x9FB21C651E98DF25) + (two ^ (two >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))

    def _least(self, lo: int, hi: int, w: int) -> np.ndarray:
        """Places of the grams of least hash, the first of equal ones, of the strings that start within [lo, hi)."""
        keyed = (self._grams(slice(lo, hi + w - 1)) & ~PLACE) | np.arange(hi + w - 1 - lo, dtype=np.uint64)  # places from lo on
        blocks = np.concatenate([keyed, np.full(-len(keyed) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = hi - lo
        return (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & PLACE).astype(np.int64) + lo

    def strings(self, piece: int) -> np.ndarray:
        """Hashes of the strings of one piece, two words each; the last bit of the second is free."""
        part = BYTE_HASHES[np.frombuffer(self.buffer, np.uint8, int(self.last[piece] - self.first[piece]) + self.length, int(self.first[piece]))]
        return np.stack([rolling(part, self.length), rolling(mixed(part), self.length, BASE_2) << np.uint64(1)], axis=1)


def distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in order, which of them each row is, how often each occurs) of rows of two words."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    held = pairs[order]
    new = np.concatenate([[True], (held[1:] != held[:-1]).any(axis=1)])[: len(pairs)]
    number = np.cumsum(new) - 1
    which = np.empty(len(pairs), np.int64)
    which[order] = number
    return held[new], which, np.bincount(number, minlength=int(new.sum()))


BYTE_HASHES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def verdicts(entries: DataFrame, crowd: int) -> DataFrame:
    """(bundle, k, code): what is answered for the entries (bundle, k, anchor, high, low, twice), those with an answer.

    All counts are summed in the tasks before they are shuffled. An anchor that very many pieces have makes one long side of
    a join, which Spark splits; the other side has one row for each key.
    """
    piece = ["high", "low"]  # the same piece has the same anchor
    each = entries.groupBy(*piece).agg(F.min("anchor").alias("anchor"), F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n"), F.min("bundle").alias("first"))
    anchors = each.groupBy("anchor").agg(F.count("*").alias("different"), F.count_if(F.col("n") == 1).alias("single"))
    asked = anchors.where("different > 1 and single > 0").select("anchor", F.when(F.col("different") > crowd, HASHES).otherwise(BYTES).alias("ask"))
    said = each.join(asked, "anchor", "left").where("n > 1 or ask is not null")
    found = entries.select("bundle", "k", *piece).join(said, piece)
    code = F.when(F.col("n") > 1, TWICE).otherwise(0) + F.when(F.col("bundle") == F.col("first"), F.coalesce("ask", F.lit(0))).otherwise(0)
    return found.select("bundle", "k", code.cast("int").alias("code")).where("code > 0")


class RunIndex:
    """Run-length Burrows-Wheeler index of pieces: match lengths kept at run ends, statistics streamed from them."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(x) + 1 for x in pieces], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.start[-1])
        raw = b"\0".join(pieces) + b"\0" * 16
        self.bytes = raw
        owner = np.repeat(np.arange(len(pieces)), sizes)
        left = self.start[owner + 1] - 1 - np.arange(n)  # bytes before the end of the piece
        suffixes = self._sorted(raw, n, owner, left)
        text = np.frombuffer(raw, np.uint8, n)
        before = text[np.arange(-1, n - 1)].astype(np.int32)
        before[self.start[:-1]] = -1 - np.arange(len(pieces))  # of pieces' starts: none equal
        before = before[suffixes]
        change = np.flatnonzero(before[1:] != before[:-1]) + 1  # run heads but the first
        self.runs = len(change) + 1
        common = self._common(suffixes[change - 1], suffixes[change], left)
        self.heads, self.head_match = self._by_place(suffixes[change], common)
        self.tails, self.tail_match = self._by_place(suffixes[change - 1], common)
        self.n = n

    @staticmethod
    def _by_place(places, values):
        order = np.argsort(places)
        return places[order], values[order]

    @staticmethod
    def _sorted(raw: bytes, n: int, owner: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Positions by suffix; ends of pieces are below all bytes and differ, in order of pieces."""
        eight = np.ndarray((n,), ">u8", raw, strides=(1,)).astype(np.uint64)
        held = np.minimum(left, 7).astype(np.uint64)
        key = (eight >> (np.uint64(64) - np.uint64(8) * held).clip(max=63)) << (np.uint64(8) * (np.uint64(7) - held))
        key = np.where(held == 0, np.uint64(0), key) << np.uint64(3) | held  # 7 bytes, cut at the piece's end, and how many are there
        order = np.argsort(key)
        k = key[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # of a group: where it begins
        ends = np.flatnonzero(left < 7)  # their keys are whole suffixes: equal ones differ by their pieces' ends only
        o = ends[np.lexsort((owner[ends], rank[ends]))]
        first = np.concatenate([[True], rank[o[1:]] != rank[o[:-1]]])
        at = np.arange(len(o))
        rank[o] += at - np.maximum.accumulate(np.where(first, at, 0))
        alone = new & np.concatenate([new[1:], [True]])
        open_ = order[~alone]
        open_ = open_[left[open_] >= 7]
        step = 7
        while len(open_):
            here, there = rank[open_], rank[np.minimum(open_ + step, n - 1)]
            o = np.lexsort((there, here)) if n >= 1 << 31 else np.argsort(here << 31 | there)
            open_, here, there = open_[o], here[o], there[o]
            first = np.concatenate([[True], here[1:] != here[:-1]])
            new = first | np.concatenate([[True], there[1:] != there[:-1]])
            at = np.arange(len(open_))
            rank[open_] = here + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
            alone = new & np.concatenate([new[1:], [True]])
            open_ = open_[~alone]
            step *= 2
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        return suffixes

    def _common(self, a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common within their pieces."""
        most = np.minimum(left[a], left[b])
        eight = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,))
        out = np.zeros(len(a), np.int64)
        go = np.flatnonzero(most > 0)
        while len(go):
            x = eight[a[go] + out[go]] ^ eight[b[go] + out[go]]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
            out[go] += same
            go = go[(same == 8) & (out[go] < most[go])]
        return np.minimum(out, most)

    def statistics(self) -> np.ndarray:
        """For every position the length of the longest match elsewhere, streamed from the run ends."""
        at = np.arange(self.n)
        best = np.zeros(self.n, np.int64)
        for places, match in ((self.heads, self.head_match), (self.tails, self.tail_match)):
            if len(places):
                k = np.searchsorted(places, at, side="right") - 1
                best = np.maximum(best, np.where(k >= 0, match[k] - (at - places[k]), 0))
        return best


def repeated_strings(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece: which of its strings of `length` bytes stand in another piece too."""
    index = RunIndex(pieces)
    long = index.statistics() >= length
    return [long[a : a + max(0, len(x) - length + 1)] for a, x in zip(index.start[:-1], pieces, strict=True)]


def remove_repeats(docs: DataFrame, length: int = 200, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept): removed is the maximal runs [start, end) of bytes, kept the other bytes."""
    rows, bundles, _ = bundled(texts(docs, id_col, text_col), target_bytes=2 << 20)
    parts = bundles

    def anchored(table):
        return Anchored(table.column("doc_id").to_pylist(), as_bytes(table.column("text").combine_chunks()), length)

    def packed(kind, part, bundle, payloads):
        n = len(part)
        return pa.table([pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(part, np.int32)), pa.array(np.broadcast_to(np.asarray(bundle, np.int32), (n,)).copy()), pa.array(payloads, pa.binary())], names=["kind", "part", "bundle", "data"])

    form = "kind int, part int, bundle int, data binary"

    def send(key, table):
        a = anchored(table)
        n = len(a.keys)
        signed = [pa.array(a.keys.view(np.int64)), pa.array(np.ascontiguousarray(a.pieces[0]).view(np.int64)), pa.array((a.pieces[1] >> np.uint64(32)).astype(np.uint32).view(np.int32))]
        return pa.table([pa.array(np.full(n, key[0].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32)), *signed, pa.array(a.twice)], names=["bundle", "k", "anchor", "high", "low", "twice"])

    def codes(a: Anchored, answers) -> np.ndarray:
        out = np.zeros(len(a.keys), np.uint8)
        kind = answers.column("kind").to_numpy()
        if (kind == 0).any():
            own = answers.filter(pa.array(kind == 0))
            out[own.column("part").to_numpy()] = np.frombuffer(b"".join(own.column("data").to_pylist()), np.uint8)
        return out

    def crowded(a: Anchored, code: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pieces of crowded anchors and the hashes of their strings."""
        which = np.flatnonzero(code & HASHES)
        return which, [a.strings(i) for i in a.one[which]]

    def offer(key, table, answers):
        a = anchored(table)
        code = codes(a, answers)
        which = np.flatnonzero(code & BYTES)
        bounds = np.searchsorted(which, part_bounds(a.keys, parts))
        at = np.flatnonzero(bounds[1:] > bounds[:-1])
        out = []
        for p in at:
            own = which[bounds[p] : bounds[p + 1]]
            one = a.one[own]
            sizes = (a.last[one] - a.first[one] + length).astype("<u4")
            need = (code[own] & TWICE == 0).astype("<u4")
            out.append(len(own).to_bytes(4, "little") + sizes.tobytes() + need.tobytes() + b"".join([a.buffer[i : j + length] for i, j in zip(a.first[one].tolist(), a.last[one].tolist(), strict=True)]))
        pieces = packed(1, at, key[0].as_py(), out)
        _, hashes = crowded(a, code)
        found, _, count = distinct(np.concatenate([np.empty((0, 2), np.uint64), *hashes]))
        bounds = part_bounds(found[:, 0], parts)
        at = np.flatnonzero(bounds[1:] > bounds[:-1])
        flagged = np.stack([found[:, 0], found[:, 1] | (count > 1).astype(np.uint64)], axis=1).astype("<u8")
        return pa.concat_tables([pieces, packed(2, at, key[0].as_py(), [flagged[bounds[p] : bounds[p + 1]].tobytes() for p in at])])

    def match(key, table):
        bundle, data = table.column("bundle").to_pylist(), table.column("data").to_pylist()
        if key[0].as_py() == 2:
            entries = np.frombuffer(b"".join(data), "<u8").reshape(-1, 2)
            _, back, count = distinct(np.stack([entries[:, 0], entries[:, 1] & ~np.uint64(1)], axis=1))
            again = (count[back] > 1) | (entries[:, 1] & np.uint64(1) > 0)
            answers = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum([len(x) // 16 for x in data])[:-1])]
        else:
            pieces, need, counts = [], [], []
            for x in data:
                n = int.from_bytes(x[:4], "little")
                sizes, flags = np.frombuffer(x, "<u4", n, 4), np.frombuffer(x, "<u4", n, 4 + 4 * n)
                at = 4 + 8 * n + np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                pieces += [x[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                need += flags.tolist()
                counts.append(n)
            found = repeated_strings(pieces, length)
            ends = np.concatenate([[0], np.cumsum(counts)])
            answers = [b"".join(np.packbits(found[i]).tobytes() for i in range(a, b) if need[i]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        some = [i for i, x in enumerate(answers) if x.strip(b"\0")]
        return packed(key[0].as_py(), table.column("part").to_numpy()[some], [bundle[i] for i in some], [answers[i] for i in some])

    def cut(key, table, answers):
        a = anchored(table)
        code = codes(a, answers)
        whole = (code & TWICE > 0) | a.twice
        covered = np.zeros(len(a.buffer) + 1, np.int32)
        every = whole[a.which] if len(a.which) else np.empty(0, bool)
        np.add.at(covered, a.first[every], 1)
        np.add.at(covered, a.last[every] + length, -1)
        places = part_bounds(a.keys, parts)
        which = np.flatnonzero((code & BYTES > 0) & (code & TWICE == 0))
        bounds = np.searchsorted(which, places)
        kinds = list(zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "data")), strict=True))

        def mark(piece: int, again: np.ndarray):
            at = a.first[piece] + np.flatnonzero(again)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + length, -1)

        for kind, p, x in kinds:
            if kind == 1:
                bits, used = np.unpackbits(np.frombuffer(x, np.uint8)), 0
                for piece in a.one[which[bounds[p] : bounds[p + 1]]].tolist():
                    n = int(a.last[piece] - a.first[piece]) + 1
                    mark(piece, bits[used : used + n])
                    used += -(-n // 8) * 8
        pieces, hashes = crowded(a, code)
        if len(pieces):
            found, back, _ = distinct(np.concatenate(hashes))
            bounds, again = part_bounds(found[:, 0], parts), np.zeros(len(found), bool)
            each = np.split(back, np.cumsum([len(h) for h in hashes])[:-1])
            for kind, p, x in kinds:
                if kind == 2:
                    n = int(bounds[p + 1] - bounds[p])
                    again[bounds[p] : bounds[p + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=n) > 0
            for k, h in zip(pieces, each, strict=True):
                if not whole[k]:
                    mark(int(a.one[k]), again[h])
        gone = np.cumsum(covered)[:-1] > 0
        raw = np.frombuffer(a.buffer, np.uint8)
        removed, kept = [], []
        for i, x in enumerate(a.data):
            own = gone[a.start[i] : a.start[i + 1]]
            if own.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                removed.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
                kept.append(raw[a.start[i] : a.start[i + 1]][~own].tobytes())
            else:
                removed.append([])
                kept.append(x)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([pa.array(a.ids, pa.int64()), pa.array([len(x) for x in a.data], pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    entries = written(rows.groupBy("bundle").applyInArrow(send, "bundle int, k int, anchor long, high long, low int, twice boolean"), "pieces")
    said = written(verdicts(entries, crowd), "verdicts")
    erase(entries)
    judged = said.select(F.lit(0).alias("kind"), F.col("k").alias("part"), "bundle", F.char("code").cast("binary").alias("data"))
    offered = rows.groupBy("bundle").cogroup(judged.groupBy("bundle")).applyInArrow(offer, form)
    matched = offered.groupBy("kind", "part").applyInArrow(match, form)
    answers = judged.unionByName(matched)
    return rows.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
