"""Document fingerprints after SpotSigs.

A signature is a common word (the anchor) with the chain of the next `chain` content words after it, `distance`
content words apart. The fingerprint of a text is its set of signature hashes. Two fingerprints are alike by the
Jaccard measure of their sets; sets whose sizes alone keep them below the threshold are never compared, and a
comparison stops as soon as the threshold is out of reach.

A word with no common word among itself and the REACH words before it is an anchor too, so that lists and languages
without anchors have signatures; the rule is local, and an edit changes signatures near it only. Null, empty or wordless texts: the empty set, alike (1) to another empty
set and unlike (0) any other. Equal texts have equal fingerprints. Repeated rows each get a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.llm.common import LAST, as_bytes, bundled, slices, texts, written

#: Anchors: the commonest words of written English, French, German and Spanish (fixed values).
ANCHORS = frozenset(
    "the of and to a in is it that was for on are as with by be this at from or an "
    "de la le les et des en un une du est que qui dans pour par sur au avec "
    "der die und das den dem von zu mit ist ein eine für auf im nicht sich des als auch "
    "el los las del se y por con para una su al lo como es".split()
)
#: Words without a common word after which each further word is an anchor.
REACH = 6
#: Sets that share a signature in a length partition up to which they meet in one place.
TILE = 2048
#: Bundles up to which the table of their neighbours is broadcast (12 bytes each).
BROADCAST_BUNDLES = 1_000_000
_BREAK = bytes.maketrans(b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\0\x1c\x1d\x1e\x1f""", b" " * 37)


class _Words(dict):
    """Hash of a word by its UTF-8 bytes; the low bit tells whether it is an anchor."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word) & ~1
        h = self[word] = h | (word.decode("utf-8", "replace") in ANCHORS)
        return h


_words = _Words()


def signatures(text: str, chain: int = 2, distance: int = 1) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the text's signatures."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_BREAK).split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    common, at = (h & np.uint64(1)).astype(bool), np.arange(len(h))
    content = at[~common]
    near = np.maximum.accumulate(np.where(common, at, -REACH - 1)) if len(h) else at
    alone = at - near > REACH
    anchor = at[common | alone]
    after = np.searchsorted(content, anchor, side="right")
    kept = (after < len(content)) | alone[anchor]
    anchor, after = anchor[kept], after[kept]
    out = h[anchor] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(chain):
        at = after + k * distance
        there = at < len(content)
        word = np.where(there, h[content[np.minimum(at, max(0, len(content) - 1))]], np.uint64(7)) if len(content) else np.zeros(0, np.uint64)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
    if not len(out) and len(h):  # common words only
        out = np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    return np.unique((out ^ (out >> np.uint64(32))).astype(np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard of two sorted sets, or 0 as soon as it is known to be under the threshold."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(large):
        return 1.0
    if len(small) < threshold * len(large) or not len(small):
        return 0.0
    shared, missed = 0, 0
    for lo in range(0, len(small), 4096):
        part = small[lo : lo + 4096]
        at = np.searchsorted(large, part)
        n = int((large[np.minimum(at, len(large) - 1)] == part).sum())
        shared, missed = shared + n, missed + len(part) - n
        if len(small) - missed < threshold * (len(large) + missed):  # the union has at least large + missed members
            return 0.0
    value = shared / (len(a) + len(b) - shared)
    return value if value >= threshold else 0.0


def text_form(codes: np.ndarray) -> str:
    """A fingerprint as text: 8 hex digits a signature, in ascending order."""
    return codes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, chain: int = 2, distance: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): sorted 32-bit signature hashes."""

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                sets = [signatures(t.decode(), chain, distance) for t in as_bytes(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "fingerprint"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint array<long>")


def length_partition(size, threshold: float):
    """Number of the length partition of a set: two sets at or over the threshold are in the same or in adjoining ones."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / float(-np.log(threshold)) + 1e-9).cast("int")


def near_pairs(docs: DataFrame, threshold: float = 0.8, chain: int = 2, distance: int = 1, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, likeness) of different fingerprints at or over the threshold, each by the number of
    its class, and members (doc_id, class, rep), rep being the class's smallest doc_id, null only where all are.
    Empty fingerprints are one class. Copies are not paired.

    Pairs share a rare signature: of the (1 - threshold) x size + 1 signatures that come first when all are ordered
    by how many sets hold them. They are joined within a length partition and the one below, and compared pruned. A
    signature that more than `tile` sets have in a partition is dealt out in tiles, pairs of slices of its sets.
    """
    rows = written(fingerprints(docs, chain, distance, id_col, text_col).withColumn("key", F.sha2(F.array_join("fingerprint", ",").cast("binary"), 256)), "spot_rows")
    classes = written(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("fingerprint").alias("fingerprint")).withColumn("class", F.monotonically_increasing_id()), "spot_classes")
    members = rows.select("doc_id", "key").join(classes.select("key", "class", "rep"), "key").select("doc_id", "class", "rep")
    each = classes.select("class", F.size("fingerprint").alias("n"), F.explode("fingerprint").alias("s"))
    counts = written(each.groupBy("s").agg(F.count("*").alias("held")).where("held > 1"), "spot_counts")  # one held once joins nothing
    ranked = each.join(counts, "s").withColumn("order", F.row_number().over(Window.partitionBy("class").orderBy("held", "s")))
    alone = F.col("n") - F.count("*").over(Window.partitionBy("class"))  # unshared signatures come first in the order
    first = ranked.withColumn("alone", alone).where(F.col("order") + F.col("alone") <= F.floor((1 - threshold) * F.col("n") + 1e-9) + 1)
    first = written(first.select("class", "n", "s", length_partition(F.col("n"), threshold).alias("p")), "spot_prefix")
    crowds = first.groupBy("s", "p").agg(F.count("*").alias("c")).where(F.col("c") > tile).select("s", "p", F.ceil(F.col("c") / tile).cast("int").alias("tiles"))
    slots = first.join(written(crowds, "spot_crowds", narrow=True), ["s", "p"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")
    # the larger set of a pair looks in its partition and the one below, in every slice there; the smaller stands in its own slice
    target = first.select("s", "p").distinct().join(written(crowds, "spot_tiles", narrow=True), ["s", "p"], "left").select("s", "p", F.coalesce("tiles", F.lit(1)).alias("tiles"))
    looks = first.select(F.col("class").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array("p", F.col("p") - 1)).alias("p")).join(target, ["s", "p"])
    one = looks.select("a", "na", "s", "p", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("slice"))
    two = slots.select(F.col("class").alias("b"), F.col("n").alias("nb"), "s", "p", own.alias("slice"))
    found = one.join(two, ["s", "p", "slice"]).where((F.col("nb") < F.col("na")) | (F.col("nb") == F.col("na")) & (F.col("b") < F.col("a"))).where(F.col("nb") >= threshold * F.col("na"))
    found = found.select("a", "b").distinct()
    x, y = classes.select(F.col("class").alias("a"), F.col("fingerprint").alias("fa")), classes.select(F.col("class").alias("b"), F.col("fingerprint").alias("fb"))

    @F.pandas_udf("double")
    def compare(fa, fb):
        return fa.__class__([jaccard(np.asarray(i), np.asarray(j), threshold) for i, j in zip(fa, fb, strict=True)], dtype="float64")

    scored = found.join(x, "a").join(y, "b").select("a", "b", compare("fa", "fb").alias("likeness")).where(F.col("likeness") >= threshold)
    return scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"), members


def with_next(docs: DataFrame, schema: str, each, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """each(ids, texts, next texts) of every document and the next one, in descending order of doc_id, in blocks.

    The next of the last document is the first. Bundles are ranges of ids; the first document of a bundle also goes
    to the one before it, so that no order over all rows is needed. Null ids come first; ties are ordered by text.
    """
    rows, bundles, cuts = bundled(texts(docs, id_col, text_col))
    key = F.coalesce("doc_id", F.lit(LAST))
    tops = {int(r[0]): int(r[1]) for r in rows.groupBy("bundle").agg(F.max(key)).collect()}  # a row a bundle
    held = sorted(tops)
    goes_to = {tops[b]: held[(i + 1) % len(held)] for i, b in enumerate(held)}  # a bundle's first is next to the last of the one above
    pairs = docs.sparkSession.createDataFrame([(k, v) for k, v in goes_to.items()] or [], "top long, guest int")
    guests = rows.join(F.broadcast(pairs) if len(held) <= BROADCAST_BUNDLES else pairs, key == F.col("top")).select(F.col("guest").alias("bundle"), F.lit(True).alias("guest"), "doc_id", "text")
    both = rows.select("bundle", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests)

    def run(table):
        ids, data, guest = table.column("doc_id").to_pylist(), as_bytes(table.column("text").combine_chunks()), table.column("guest").to_pylist()
        order = lambda i: (-(LAST if ids[i] is None else ids[i]), data[i])
        own = sorted((i for i in range(len(ids)) if not guest[i]), key=order)
        after = sorted((i for i in range(len(ids)) if guest[i]), key=order)
        following = [*own[1:], (after or own)[0]] if own else []
        return each([ids[i] for i in own], [data[i].decode() for i in own], [data[i].decode() for i in following])

    return both.groupBy("bundle").applyInArrow(run, schema)
