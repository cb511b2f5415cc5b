"""The pipeline's stages against brute force, each on what the stage before kept."""

import re

import pytest
import xxhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_ops import spans_of  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or ({" ".join(w)} if w else set())


def long_fingerprint(text):
    """128 bits: those of the hashes of distinct shingles, and those of the hashes mixed once more."""
    first = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles(text)]
    full = (1 << 64) - 1

    def mixed(h):
        h = ((h ^ h >> 32) * (0xBF58476D1CE4E5B9 + 2)) & full
        h = ((h ^ h >> 29) * 0x94D049BB133111EB) & full
        return h ^ h >> 32

    return [sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) for hashes in (first, [mixed(h) for h in first])]


def near_copies(texts):
    """The smallest id that each document reaches: pairs of 25 differing bits or fewer, of them 2 or fewer in one of the six parts."""
    prints = {d: long_fingerprint(t) for d, t in texts.items()}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def met(x, y):
        return any(((x ^ y) >> at & (1 << size) - 1).bit_count() <= 2 for at, size in ((0, 21), (21, 21), (42, 22)))

    for a, x in prints.items():
        for b, y in prints.items():
            if a < b and sum((i ^ j).bit_count() for i, j in zip(x, y, strict=True)) <= 25 and any(met(i, j) for i, j in zip(x, y, strict=True)):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in root}


def test_stages(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10_000, None, None, None, None), (10_001, "?! 12", "en", "s", 5), (10_002, "Ein token = 'abcdefgh' und", "de", "s", 26)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after) and set(after) <= set(before)
        if name == "language":
            assert set(before) - set(after) == {10_000, 10_001}
        if name == "near_dedup":
            root = near_copies({d: r.text for d, r in before.items()})
            assert set(after) == {d for d in before if root[d] == d}
            sets = {d: shingles(r.text) for d, r in before.items()}
            like = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])]
            assert like and all(root[a] == root[b] for a, b in like)
        if name == "decontamination":
            assert set(before) - set(after) == {d for d, r in before.items() if any(i in r.text.lower() for i in items)}
        if name == "secrets":
            assert set(after) == set(before) and any("[SECRET]" in r.text for r in after.values())
            for d, r in after.items():
                assert not spans_of(r.text) and r.n_chars == len(r.text)
                assert r.text == before[d].text or re.search(r"\[SECRET\]", r.text)
        if name == "tokens":
            assert set(after) == set(before) and all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in after.values())
        else:
            assert docs.columns == columns


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_rows_without_or_with_repeated_ids_are_told_apart(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = [r.text for r in docs.where("lang = 'en' and n_chars between 800 and 4000").orderBy("doc_id").limit(8).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    keys = [None, None, None, None, None, 7, 7, 3, None]
    texts = [base[0], base[1], base[2], f"{base[3]} {item}", "?! 12", base[4], base[5], base[0], base[1]]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in zip(keys, texts, strict=True)], docs.schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(((r.doc_id or 0, r.text) for r in docs.collect()))
    rows = [(k or 0, t) for k, t in zip(keys, texts, strict=True)]
    assert kept["language"] == sorted(r for i, r in enumerate(rows) if i != 4)
    assert kept["near_dedup"] == sorted(rows[i] for i in (1, 2, 3, 5, 6, 7))
    assert kept["decontamination"] == sorted(rows[i] for i in (1, 2, 5, 6, 7))
