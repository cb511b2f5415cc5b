"""SimHash near-duplicates, linked by anchor-point covering.

Fingerprints, of 64 bits a lane, are cut into parts. The anchors of a part are the words of a covering code: the
Hamming code on its low bits, all words on the rest, covering radius 1. Each fingerprint goes to every anchor within 2
(the radius, and half of the 2 bits that two members of an anchor may differ by in the part): of words that differ in
2 bits one lies between them, and its nearest anchor is within 2 of both. So all pairs that differ by 2 bits or fewer
in some part meet, and threshold // 3 + 1 parts find every pair within the threshold; where parts would be too short for
a good code, the last one may be shorter and of reach 1 (see layout). Members are compared per anchor; an anchor with many members is dealt out in tiles of
pairs of slices. A tile returns a spanning star of its links, not all pairs; stars are joined by alternating
large-star and small-star rounds over tables in the shared folder.

Null or wordless text: fingerprint 0, linked like any other. Equal fingerprints are one node; its copies are never
paired. Repeated rows each get a row. A null doc_id never names a component unless alone.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.common import as_bytes, blob_of, erase, slices, texts, written

SEED = 42
MIX = 0xBF58476D1CE4E5B9
#: Members of an anchor that one tile holds from each of its two slices.
TILE = 4096


def shingle_hashes(data: bytes, width: int) -> list[int]:
    words = data.lower().split()  # of bytes: A-Z only, and exactly space and \x09-\x0D
    n, digest = len(words), xxhash.xxh64_intdigest
    if n <= width:
        return [digest(b" ".join(words), SEED)] if n else []
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    return [digest(joined[a:b], SEED) for a, b in zip((end - size)[: n - width + 1].tolist(), end[width - 1 :].tolist(), strict=True)]


def simhash(data: bytes, width: int = 4, lanes: int = 1, distinct: bool = False) -> list[int]:
    """64 bits a lane. A bit is 1 if it is set in over half of the shingles' hashes, repeats included unless distinct.

    The hashes of further lanes are made from those of the first by a mixing function.
    """
    hashes = np.array(shingle_hashes(data, width), np.uint64)
    if distinct:
        hashes = np.unique(hashes)
    out = []
    for lane in range(lanes):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            if lane:
                part = (part ^ part >> np.uint64(32)) * np.uint64(MIX + 2 * lane)
                part = (part ^ part >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
                part ^= part >> np.uint64(32)
            counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]))
    return out


def lane_names(lanes: int) -> list[str]:
    return ["fp", *(f"fp{i}" for i in range(1, lanes))]


def fingerprints(docs: DataFrame, width: int = 4, lanes: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text", blob: bool = False) -> DataFrame:
    """(doc_id, fp, fp1, ...): the lanes of the fingerprint as signed longs; blob adds the text's SHA-256."""
    more = ["blob"] if blob else []
    names = lane_names(lanes)

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                fp = np.array([simhash(x, width, lanes, distinct) for x in as_bytes(b.column(1))], dtype=np.uint64).view(np.int64).reshape(-1, lanes)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(fp[:, i].copy()) for i in range(lanes)), *b.columns[2:]], ["doc_id", *names, *more])

    rows = texts(docs, id_col, text_col).select("doc_id", "text", *[blob_of(F.col("text")).alias(c) for c in more])
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", blob string" * blob)


class AnchorCode:
    """Words of one part of `length` bits: a Hamming code on the low 2^r - 1 bits times all words on the others."""

    def __init__(self, length: int, reach: int):
        r = (length + 1).bit_length() - 1
        self.low = min(length, (1 << r) - 1)
        self.free = range(self.low, length)
        by_syndrome: dict[int, list[int]] = {s: [] for s in range(1 << r)}
        for weight in range(reach + 1):
            for bits in combinations(range(length), weight):
                s = 0
                for b in bits:
                    s ^= b + 1 if b < self.low else 0
                by_syndrome[s].append(sum(1 << b for b in bits))
        # a word and a mask of its own syndrome differ by a code word: these masks reach all anchors within `reach`
        width = max(map(len, by_syndrome.values()))
        self.masks = np.array([[*m, *[-1] * (width - len(m))] for _, m in sorted(by_syndrome.items())], dtype=np.int64)

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the word, anchor) for every anchor within reach."""
        syndrome = np.zeros(len(words), np.int64)
        for b in range(self.low):
            syndrome ^= ((words >> b) & 1) * (b + 1)
        masks = self.masks[syndrome]
        at = np.nonzero(masks >= 0)
        return at[0], words[at[0]] ^ masks[at]


class DropCode:
    """Words of one part with one of their bits left out: words that differ in one bit or none meet."""

    def __init__(self, length: int):
        self.length = length

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(np.arange(len(words)), self.length)
        bit = np.tile(np.arange(self.length), len(words))
        return at, words[at] & ~(1 << bit) | bit << self.length


def layout(bits: int, threshold: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, reach) of parts: every pair within the threshold differs by `reach` bits or fewer in one of them.

    For reach + 1 sums to more than the threshold. Parts are of one size, unless they would be shorter than the
    Hamming code of 15 bits and a short last part of reach 1 is enough beside parts of 15.
    """
    n, full = threshold // 3 + 1, threshold // 3
    if threshold % 3 == 1 and bits // n < 15 and bits > 15 * full:
        return [*((15 * i, 15, 2) for i in range(full)), (15 * full, bits - 15 * full, 1)]
    cut = [bits * i // n for i in range(n + 1)]
    return [(x, y - x, 2) for x, y in zip(cut, cut[1:], strict=False)]


def covered(nodes: DataFrame, threshold: int) -> DataFrame:
    """(key, fp, ..., rep): a row for each anchor of each part that a fingerprint is near enough to.

    All pairs of nodes within the threshold meet at some key.
    """
    names = [c for c in nodes.columns if c.startswith("fp")]
    parts = [(at, size, AnchorCode(size, 1 + 1) if reach == 2 else DropCode(size)) for at, size, reach in layout(64 * len(names), threshold)]

    def word(lanes, at, size):
        """The bits of a part, which may lie in two lanes."""
        low, off = divmod(at, 64)
        out = lanes[low] >> np.uint64(off)
        if off + size > 64:
            out = out | lanes[low + 1] << np.uint64(64 - off)
        return (out & np.uint64((1 << size) - 1)).astype(np.int64)

    def run(batches):
        for b in batches:
            *fps, rep = (b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names) + 1))
            lanes = [x.view(np.uint64) for x in fps]
            for k, (at, size, code) in enumerate(parts):
                i, anchor = code.anchors(word(lanes, at, size))
                key = anchor | (k << 48)
                for lo in range(0, len(key), 1 << 16):
                    j = i[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + (1 << 16)]), *(pa.array(x[j]) for x in fps), pa.array(rep[j])], ["key", *names, "rep"])

    return nodes.select(*names, "rep").mapInArrow(run, "key long, " + "".join(f"{c} long, " for c in names) + "rep long")


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) of a forest with the same components as the edges a-b; root is the smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    member = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[label[member]], nodes[member]


#: Rows of one key from which on all pairs of blocks are compared at once, and the rows of a block.
CROWD, BLOCK = 64, 256


def block_pairs(lanes: np.ndarray, threshold: int):
    """(i, j), i < j, of the rows of one key that are within the threshold, a block of rows at a time."""
    n = lanes.shape[1]
    kind = np.uint8 if len(lanes) < 4 else np.uint16
    for lo in range(0, n, BLOCK):
        far = np.zeros((min(BLOCK, n - lo), n - lo), kind)
        for bits in lanes:
            far += np.bitwise_count(bits[lo : lo + BLOCK, None] ^ bits[None, lo:])
        i, j = np.divmod(np.flatnonzero(far <= threshold), n - lo)
        kept = i < j
        yield lo + i[kept], lo + j[kept]


def close_pairs(key: np.ndarray, lanes: np.ndarray, rep: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of the links among rows of equal key; rows are sorted by key, lanes has a row a lane."""
    left, right, held = [], [], 0

    def add(a, b):
        nonlocal left, right, held
        left.append(a)
        right.append(b)
        held += len(a)
        if held > 1 << 18:
            a, b = star(np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], 0

    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    size = np.diff(first, append=len(key))
    for lo, n in zip(first[size > CROWD].tolist(), size[size > CROWD].tolist(), strict=True):
        own = rep[lo : lo + n]
        for i, j in block_pairs(lanes[:, lo : lo + n], threshold):
            add(own[i], own[j])
    few = np.repeat(size <= CROWD, size)
    key, lanes, rep = key[few], lanes[:, few], rep[few]
    shift, at = 1, np.arange(len(key))
    while len(at):
        at = at[at < len(key) - shift]
        at = at[key[at] == key[at + shift]]
        far = np.zeros(len(at), np.int64)
        for bits in lanes:
            far += np.bitwise_count(bits[at] ^ bits[at + shift])
        near = at[far <= threshold]
        add(rep[near], rep[near + shift])
        shift += 1
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return star(np.concatenate(left), np.concatenate(right))


def links(nodes: DataFrame, threshold: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b), a < b: edges with the same components as all pairs of nodes (fp, ..., rep) that are within the threshold."""
    names = [c for c in nodes.columns if c.startswith("fp")]
    near = covered(nodes, threshold)
    crowded = written(near.groupBy("key").count().where(F.col("count") > tile), "crowded", narrow=True)
    n = crowded.count()
    if n:
        salts = crowded.select("key", F.ceil(F.col("count") / tile).cast("int").alias("s"))
        salts = F.broadcast(salts) if n <= 100_000 else salts
        own = F.pmod(F.xxhash64("rep"), F.col("s")).cast("int")
        near = (
            near.join(salts, "key", "left")
            .withColumns({"s": F.coalesce("s", F.lit(1))})
            .select("key", *names, "rep", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("other"))
            .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *names, "rep")
        )
        place = ["key", "i", "j"]
    else:
        place = ["key"]

    def run(batches):
        rest = None
        for b in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
            ends = np.nonzero((rows[: len(place), 1:] != rows[: len(place), :-1]).any(axis=0))[0]
            cut = ends[-1] + 1 if len(ends) else 0
            rest = rows[:, cut:]
            if cut:
                yield from compare(rows[:, :cut])
        if rest is not None and rest.shape[1]:
            yield from compare(rest)

    def compare(rows):
        new = np.concatenate([[True], (rows[: len(place), 1:] != rows[: len(place), :-1]).any(axis=0)])
        a, b = close_pairs(np.cumsum(new), rows[len(place) : -1].view(np.uint64), rows[-1], threshold)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = near.select(*place, *names, "rep").repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches, itself left out.

    Each round's tables are deleted when the next one's are there.
    """

    def mark(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    held = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges", narrow=True)
    seen = mark(held)
    while True:
        ends = held.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(held.select(F.col("a").alias("u"), F.col("b").alias("v")))
        low = written(ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large_star", narrow=True)
        large = written(ends.join(low, "u").where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a")).where("a < b"), "large", narrow=True)
        least = written(large.groupBy("b").agg(F.min("a").alias("m")), "small_star", narrow=True)
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("a").alias("b"), F.col("m").alias("a")), F.struct("b", F.col("m").alias("a")))).alias("e")).select("e.a", "e.b").where("a < b")
        new = written(small.distinct(), "edges", narrow=True)
        erase(held, low, large, least)
        now = mark(new)
        if now == seen:
            return new.select(F.col("b").alias("node"), F.col("a").alias("component"))
        held, seen = new, now


def grouped(rows: DataFrame, first, threshold: int) -> DataFrame:
    """(fp, ..., first, root) of the distinct fingerprints of rows: the aggregate `first` of each and its component.

    Nodes are the fingerprints, numbered as they stand in a written table, so that no id has to stand for a missing one.
    """
    names = [c for c in rows.columns if c.startswith("fp")]
    nodes = written(rows.groupBy(*names).agg(first.alias("first")).withColumn("rep", F.monotonically_increasing_id()), "simhash_nodes")
    roots = connected_components(links(nodes.select(*names, "rep"), threshold))
    return written(nodes.join(roots, nodes.rep == roots.node, "left").select(*names, "first", F.coalesce("component", "rep").alias("root")), "simhash_members")


def near_duplicates(docs: DataFrame, threshold: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable over links, null ids left out."""
    rows = written(fingerprints(docs, width, id_col=id_col, text_col=text_col), "simhash")
    member = grouped(rows, F.min("doc_id"), threshold)
    named = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(member.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def heads(docs: DataFrame, threshold: int = 25, width: int = 5, lanes: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, n): of each group of linked fingerprints the row of the smallest id, then text hash, and how often it occurs.

    The fingerprints are of distinct shingles, so that their distance follows the Jaccard similarity J of the texts' shingle
    sets: with equal sizes a bit differs with the chance acos(2J / (1 + J)) / pi, at J = 0.8 that is 0.15. All pairs that
    differ by 25 bits of 128 or fewer are linked: the rule is the fingerprints' distance, which estimates J. Rows of
    different texts are told apart where ids are null or repeated.
    """
    rows = written(fingerprints(docs, width, lanes, distinct=True, id_col=id_col, text_col=text_col, blob=True), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("blob").alias("head")))
    found = written(grouped(rows, first, threshold).groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.head"), "simhash_heads")
    held = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("blob") == F.col("head")))
    return held.groupBy("doc_id", "blob").agg(F.count("*").alias("n"))
