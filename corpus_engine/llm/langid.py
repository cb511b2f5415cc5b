"""Language identification with string kernels.

The kernel of two texts is the number of n-grams (n = 1, 2, 3 of folded characters) that occur in both, divided by
the geometric mean of the numbers in each: the normalised blended-spectrum presence kernel. Landmarks are labelled
texts; the Nystroem map sends a text to its kernel values with the landmarks times the inverse root of the landmark
kernel, and one-versus-rest kernel ridge regression in that space gives a score for each language. Documents are scored
in batches by two matrix products: presence x landmark presence, and kernel values x weights.

Letters are folded to lower case, runs of anything else to one blank. An n-gram's code is a hash of its code points
into 2^21 codes, so that all scripts keep their letters apart.

Training reads a bounded sample: of every language the texts whose id and text hash lowest, `per_language` of each and
`most_rows` in all (one of each language at least), as sets of n-gram codes. The choice is made in Spark; the driver
gets these rows only. Whole texts are used in training and in scoring.

Null text or a text without a letter: `und`, score 0. No labelled row: all `und`. Labels that are null are not learned.
Repeated rows each get a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_engine.llm.common import P, blob_of, slices, written

#: Labels up to which their table is broadcast (some 50 bytes each).
BROADCAST_LABELS = 100_000

#: Bits of an n-gram's code.
BITS = 21
CODES = 1 << BITS
#: Odd multipliers that mix the code points of an n-gram (fixed values).
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
LETTER = re.compile(r"[^\W\d_]")
_fold = np.zeros(0x110000, np.uint32)
_owner = np.zeros(CODES, np.int32)  # a place for each code; nothing is read from it that was not just written


def fold_table() -> np.ndarray:
    """For each code point the lower-case letter it stands for, 0 for anything but a letter."""
    if not _fold.any():
        for cp in range(0x110000):
            if chr(cp).isalpha():
                _fold[cp] = ord(chr(cp).lower()[0])
    return _fold


def grams(text: str) -> np.ndarray:
    """Distinct codes of the text's 1-, 2- and 3-grams; runs of non-letters count as one."""
    s = fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate([[0], s, [0]]).astype(np.uint64)
    one = (s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])] + np.uint64(1)) * np.uint64(MIX[0])
    top = np.uint64(64 - BITS)
    codes, held = [one >> top], one
    for n in (1, 2):
        held = (held[:-1] ^ held[:-1] >> np.uint64(29)) * np.uint64(MIX[n]) + one[n:]
        codes.append((held ^ held >> np.uint64(32)) * np.uint64(MIX[2]) >> top)
    found = np.concatenate(codes).astype(np.int32)
    place = np.arange(len(found), dtype=np.int32)
    _owner[found] = place  # of equal codes the last one stays
    return np.sort(found[_owner[found] == place])


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # sorted codes that occur in landmarks
    landmarks: np.ndarray  # vocabulary x landmarks, presence
    sizes: np.ndarray  # codes of each landmark
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        present = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for i, codes in enumerate(sets):
            at = np.searchsorted(self.vocabulary, codes)
            at[at == len(self.vocabulary)] = 0
            present[i, at[self.vocabulary[at] == codes]] = 1
        size = np.array([max(1, len(c)) for c in sets], np.float32)
        kernel = present @ self.landmarks / np.sqrt(size[:, None] * self.sizes)
        return kernel @ self.weights + self.bias


def train(sets: list[np.ndarray], labels: list[str], landmarks: int = 160, ridge: float = 1e-2) -> Model:
    languages = sorted(set(labels))
    by = {x: [i for i, y in enumerate(labels) if y == x] for x in languages}
    chosen = [i for x in languages for i in by[x][: max(1, landmarks // len(languages))]]
    vocabulary = np.unique(np.concatenate([sets[i] for i in chosen]))
    shown = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        shown[np.searchsorted(vocabulary, sets[i]), k] = 1
    sizes = np.array([len(sets[i]) for i in chosen], np.float32)
    base = Model(languages, vocabulary, shown, sizes, np.eye(len(chosen), dtype=np.float32), np.zeros(1, np.float32))
    kernel = base.scores(sets).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    root = vectors / np.sqrt(np.maximum(values, 1e-6 * values.max()))  # K_mm^-1/2, up to a rotation
    x = kernel @ root
    y = np.array([[1.0 if z == q else -1.0 for q in languages] for z in labels])
    balance = np.array([len(labels) / (len(languages) * len(by[z])) for z in labels])[:, None]  # rare languages count as much
    centre = (x * balance).mean(0) / balance.mean()
    middle = (y * balance).mean(0) / balance.mean()
    xc = x - centre
    w = np.linalg.solve((xc * balance).T @ xc + ridge * len(labels) * np.eye(x.shape[1]), (xc * balance).T @ (y - middle))
    base.weights, base.bias = (root @ w).astype(np.float32), (middle - centre @ w).astype(np.float32)
    return base


def sample(labelled: DataFrame, per_language: int, most_rows: int, id_col: str, text_col: str, label_col: str) -> tuple[list[np.ndarray], list[str]]:
    """The texts of each label with the lowest hashes of id and text, as code sets: per_language of each, most_rows in all."""
    named = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("y"), F.col(text_col).alias("x"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)).alias("h"))
    counts = written(named.groupBy("y").count(), "languages", narrow=True)
    n = counts.count()
    if not n:
        return [], []
    most = max(1, min(per_language, most_rows // n))
    # first a share of each language that holds about twice what is needed, so that few texts are turned into sets
    share = counts.select(F.col("y").alias("s_y"), F.least(F.lit(1 << 40), (F.lit(float(1 << 40)) * (2 * most + 50) / F.col("count")).cast("long")).alias("cut"))
    few = named.join(F.broadcast(share) if n <= BROADCAST_LABELS else share, (F.col("y") == F.col("s_y")) & (F.col("h") < F.col("cut")))

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                y, x, h = (b.column(i).to_pylist() for i in range(3))
                ok = [i for i, t in enumerate(x) if LETTER.search(t)]
                yield pa.RecordBatch.from_arrays([pa.array([y[i] for i in ok], pa.string()), pa.array([h[i] for i in ok], pa.int64()), pa.array([grams(x[i]).tobytes() for i in ok], pa.binary())], ["y", "h", "codes"])

    sets = few.select("y", "x", "h").mapInArrow(run, "y string, h long, codes binary")
    rows = sets.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy("h", "codes"))).where(F.col("n") <= most)
    held = sorted(rows.collect(), key=lambda r: (r["y"], r["n"]))  # a bounded sample
    return [np.frombuffer(r["codes"], np.int32) for r in held], [r["y"] for r in held]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", blob: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score): score is a softmax over the languages' ridge outputs; blob adds the text's SHA-256."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks only: a bound of the model, not of the input

    def run(batches):
        m = shared.value
        for batch in batches:
            for b in slices(batch):
                texts = b.column(1).to_pylist()
                named = [i for i, t in enumerate(texts) if m is not None and t and LETTER.search(t)]
                pred, score = ["und"] * len(texts), np.zeros(len(texts))
                if named:
                    f = m.scores([grams(texts[i]) for i in named]).astype(np.float64)
                    best = f.argmax(1)
                    p = np.exp(4 * (f - f.max(1, keepdims=True)))
                    for i, k, v in zip(named, best, 1 / p.sum(1), strict=True):
                        pred[i], score[i] = m.languages[k], v
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score), *b.columns[2:]], ["doc_id", "lang_pred", "score", *more])

    more = ["blob"] if blob else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[blob_of(F.col(text_col)).alias(c) for c in more])
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double" + ", blob string" * blob)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that are never trained on: crc32 of the id as text divisible by folds; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, per_language: int = 400, most_rows: int = 40_000, landmarks: int = 160, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    sets, labels = sample(docs.where(~held_out(F.col(id_col))), per_language, most_rows, id_col, text_col, label_col)
    return train(sets, labels, max(landmarks, 8 * len(set(labels)))) if sets else None


def accepted(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of docs whose text has a letter and whose language is known with at least the score `least`.

    A row goes for its own text only, not for that of another row of its id.
    """
    from corpus_engine.llm.common import P, written

    found = predict(docs, fit(docs), blob=True).where((F.col("lang_pred") == "und") | (F.col("score") < least))
    bad = written(found.select(F.col("doc_id").alias(f"{P}bad"), F.col("blob").alias(f"{P}blob")).distinct(), "languages", narrow=True)
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(f"{P}bad")) & (blob_of(F.col("text")) == F.col(f"{P}blob")), "left_anti")
