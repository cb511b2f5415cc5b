"""Exact substring dedup: Rabin-Karp hashes of every window of `width` words, counted over the cluster.

Documents are bundled by ranges of doc_id. A bundle hashes all its windows with two rolling polynomials over word hashes,
keeps each distinct hash once (the first copy in id order), and sends the hashes, dealt by value, as packed rows: a
window that occurs everywhere costs one entry a bundle, not one a document. A part of the hash space finds which
bundles hold a hash that an earlier bundle has, and answers with one bit an entry. Back in the bundle, a window is
repeated if it stands in an earlier bundle or in an earlier document of its own; repeated windows merge into maximal
removal intervals of words.

Bundles and parts would exchange a row for each pair of them. Beyond SHELVES_FROM bundles the exchange has two steps:
bundles send to blocks of parts, and a shelf of neighbouring bundles deals what it sent to a block out to its parts. With
n bundles that is n ** 1.5 rows, not n ** 2; what is found is the same.

Null or empty text, or one of fewer words than a window: nothing is removed. Rows of equal doc_id (repeated rows)
never count against each other, since none has a smaller id. A null doc_id counts as the largest.
Hashes have 88 bits, 11 bytes an entry: among the 1.5 x 10^13 windows of 100 TB less than one false match is expected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import LAST, as_bytes, bundled, texts

BASE, BASE_2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
#: Bundles up to which each sends to every part.
SHELVES_FROM = 4096


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose high bits depend on all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(words: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Polynomial hash of every `width` consecutive entries, built by doubling."""
    out, done = np.zeros(len(words), np.uint64), 0
    power, size = words, 1
    factor = lambda n: np.uint64(pow(base, n, 1 << 64))
    while done < width:
        if width & size:
            tail = power[done:] if done else power
            n = len(tail)
            out = tail if not done else out[:n] * factor(size) + tail
            done += size
        if done < width:
            power = power[: len(power) - size] * factor(size) + power[size:] if len(power) > size else power[:0]
            size *= 2
    return mixed(out[: max(0, len(words) - width + 1)])


class Bundle:
    """The windows of a bundle's documents, sorted by id."""

    def __init__(self, ids: list, data: list[bytes], width: int):
        order = sorted(range(len(ids)), key=lambda i: (LAST if ids[i] is None else ids[i]))
        self.ids, self.words = [ids[i] for i in order], [data[i].split() for i in order]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(counts)])
        hashes = np.fromiter((h for w in self.words for h in map(_words.__getitem__, w)), np.uint64, int(self.start[-1]))
        first = np.concatenate([np.arange(a, b - width + 1) for a, b in zip(self.start[:-1], self.start[1:], strict=True)] or [np.empty(0, np.int64)]).astype(np.int64)
        self.at = first  # word at which each window starts
        if len(first):
            self.high = rolling(hashes, width)[first]
            self.low = (rolling(mixed(hashes * np.uint64(BASE_2)), width, BASE_2)[first] >> np.uint64(40)).astype(np.uint32)
        else:
            self.high, self.low = np.empty(0, np.uint64), np.empty(0, np.uint32)
        _, self.first, self.which = np.unique(self.high, return_index=True, return_inverse=True)
        if len(first) and (self.low[self.first][self.which] != self.low).any():  # two windows share 64 bits: order by all 88
            order = np.lexsort((np.arange(len(first)), self.low, self.high))
            new = np.concatenate([[True], (self.high[order][1:] != self.high[order][:-1]) | (self.low[order][1:] != self.low[order][:-1])])
            self.first = order[new]
            self.which = np.empty(len(first), np.int64)
            self.which[order] = np.cumsum(new) - 1
        self.high, self.low = self.high[self.first], self.low[self.first]  # distinct and sorted

    def entries(self, lo: int, hi: int) -> bytes:
        return pack(self.high[lo:hi], self.low[lo:hi])


def pack(high: np.ndarray, low: np.ndarray) -> bytes:
    """Eleven bytes an entry."""
    return high.astype("<u8").tobytes() + low.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, entries of each)."""
    sizes = np.array([len(x) // 11 for x in packed], np.int64)
    high = np.frombuffer(b"".join(x[: 8 * n] for x, n in zip(packed, sizes.tolist(), strict=True)), "<u8")
    three = np.frombuffer(b"".join(x[8 * n :] for x, n in zip(packed, sizes.tolist(), strict=True)), np.uint8).reshape(-1, 3)
    low = three[:, 0].astype(np.uint32) | three[:, 1].astype(np.uint32) << 8 | three[:, 2].astype(np.uint32) << 16
    return high, low, sizes


def part_bounds(distinct: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's entries begin among sorted distinct hashes."""
    cuts = np.array([((p << 64) + parts - 1) // parts for p in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(distinct, cuts), [len(distinct)]])


def part_bounds_within(high: np.ndarray, starts: np.ndarray, ends: np.ndarray, parts: int, block: int, shelf: int) -> np.ndarray:
    """For each sorted run [start, end) of hashes of a block, where the entries of each of its parts begin, and the end."""
    cuts = np.array([((p << 64) + parts - 1) // parts for p in range(block * shelf + 1, (block + 1) * shelf)], dtype=np.uint64)
    return np.array([[a, *(a + np.searchsorted(high[a:b], cuts)), b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", shelf: int | None = None) -> DataFrame:
    """(doc_id, n_words, removed, kept): removed is the maximal intervals [start, end) of words, kept the rest's text."""
    rows, bundles, _ = bundled(texts(docs, id_col, text_col))
    shelf = shelf or (1 if bundles <= SHELVES_FROM else int(bundles**0.5) + 1)
    parts = -(-bundles // shelf) * shelf  # a bundle of 6 MB has about a million windows, and so has a part, the unit of counting
    blocks = parts // shelf
    form = "part int, bundle int, data binary"

    def packed(part, bundle, data):
        n = len(part)
        return pa.table([pa.array(np.asarray(part, np.int32)), pa.array(np.broadcast_to(np.asarray(bundle, np.int32), (n,)).copy()), pa.array(data, pa.binary())], names=["part", "bundle", "data"])

    def send(key, table):
        """The entries of a bundle, a row for each block of parts."""
        bundle = Bundle(table.column("doc_id").to_pylist(), as_bytes(table.column("text").combine_chunks()), width)
        bounds = part_bounds(bundle.high, blocks)
        at = np.nonzero(bounds[1:] > bounds[:-1])[0]
        return packed(at, key[0].as_py(), [bundle.entries(bounds[p], bounds[p + 1]) for p in at])

    def deal(key, table):
        """What the bundles of a shelf sent to a block, a row for each of its parts: numbers of entries, then the entries."""
        at_shelf, block = (k.as_py() for k in key)
        table = table.sort_by("bundle")
        high, low, sizes = unpack(table.column("data").to_pylist())
        ends = np.cumsum(sizes)
        bounds = part_bounds_within(high, ends - sizes, ends, parts, block, shelf)
        out = []
        for p in range(shelf):
            spans = [(bounds[i, p], bounds[i, p + 1]) for i in range(len(sizes))]
            own = np.concatenate([np.arange(a, b) for a, b in spans])
            if len(own):
                out.append((block * shelf + p, np.array([b - a for a, b in spans], "<u4").tobytes() + pack(high[own], low[own])))
        return packed([p for p, _ in out], at_shelf, [len(sizes).to_bytes(4, "little") + x for _, x in out])

    def count(table):
        """A bit for every entry of a part: whether an earlier bundle holds it too."""
        table = table.sort_by("bundle")
        data = table.column("data").to_pylist()
        heads = [4 + 4 * int.from_bytes(x[:4], "little") if shelf > 1 else 0 for x in data]
        high, low, sizes = unpack([x[n:] for x, n in zip(data, heads, strict=True)])
        order = np.lexsort((low, high))  # stable: earlier bundles first, on a shelf as well
        h, w = high[order], low[order]
        again = np.zeros(len(high), bool)
        again[order[1:]] = (h[1:] == h[:-1]) & (w[1:] == w[:-1])
        own = np.split(again, np.cumsum(sizes)[:-1])
        some = [i for i, x in enumerate(own) if x.any()]
        return packed(table.column("part").to_numpy()[some], table.column("bundle").to_numpy()[some], [np.packbits(own[i]).tobytes() for i in some])

    def gather(key, sent, found):
        """The parts' answers for a shelf and block, put together for each bundle."""
        sent = sent.sort_by("bundle")
        high, _, sizes = unpack(sent.column("data").to_pylist())
        ends = np.cumsum(sizes)
        block = key[1].as_py()
        bounds = part_bounds_within(high, ends - sizes, ends, parts, block, shelf)
        again = np.zeros(len(high), bool)
        for part, bits in zip(found.column("part").to_pylist(), found.column("data").to_pylist(), strict=True):
            p = part - block * shelf
            own = np.concatenate([np.arange(bounds[i, p], bounds[i, p + 1]) for i in range(len(sizes))])
            again[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        each = np.split(again, ends[:-1])
        some = [i for i, x in enumerate(each) if x.any()]
        return packed(np.full(len(some), block), sent.column("bundle").to_numpy()[some], [np.packbits(each[i]).tobytes() for i in some])

    def cut(table, answers):
        bundle = Bundle(table.column("doc_id").to_pylist(), as_bytes(table.column("text").combine_chunks()), width)
        bounds = part_bounds(bundle.high, blocks)
        earlier = np.zeros(len(bundle.high), bool)
        for p, bits in zip(answers.column("part").to_pylist(), answers.column("data").to_pylist(), strict=True):
            n = bounds[p + 1] - bounds[p]
            earlier[bounds[p] : bounds[p + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(n)).astype(bool)
        # a document's number counts the distinct ids before it, so that equal ids aren't earlier than one another
        rank, n = [], -1
        for i, d in enumerate(bundle.ids):
            n += i == 0 or d != bundle.ids[i - 1]
            rank.append(n)
        rank = np.array(rank, np.int64)
        doc_of = rank[np.searchsorted(bundle.start, bundle.at, side="right") - 1] if len(bundle.at) else bundle.at
        again = earlier[bundle.which] | (doc_of > doc_of[bundle.first][bundle.which]) if len(bundle.at) else np.empty(0, bool)
        step = np.zeros(bundle.start[-1] + width + 1, np.int32)
        np.add.at(step, bundle.at[again], 1)
        np.add.at(step, bundle.at[again] + width, -1)
        gone = np.cumsum(step)[: bundle.start[-1]] > 0
        removed, kept = [], []
        for i, words in enumerate(bundle.words):
            own = gone[bundle.start[i] : bundle.start[i + 1]]
            if own.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                removed.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                kept.append(b" ".join([words[k] for k in np.flatnonzero(~own)]))
            else:
                removed.append([])
                kept.append(b" ".join(words))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([pa.array(bundle.ids, pa.int64()), pa.array([len(w) for w in bundle.words], pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "removed", "kept"])

    sent = rows.groupBy("bundle").applyInArrow(send, form)
    if shelf == 1:
        answers = sent.groupBy("part").applyInArrow(count, form)
    else:
        by_block = [F.floor(F.col("bundle") / shelf).cast("int").alias("shelf"), F.col("part").alias("block")]
        dealt = sent.groupBy(*by_block).applyInArrow(deal, form)
        found = dealt.groupBy("part").applyInArrow(count, form)  # their bundle is the shelf
        back = found.groupBy(F.col("bundle").alias("shelf"), F.floor(F.col("part") / shelf).cast("int").alias("block"))
        answers = sent.groupBy(*by_block).cogroup(back).applyInArrow(gather, form)
    return rows.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(cut, "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string")
