"""The dealt operators against brute force, on tables with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpus_engine.llm import bpe, decontaminate, langid, licenses, queries, runindex, secrets, sharding, simhash, spotsigs, substrings

SCHEMA = "doc_id long, text string, lang string, shard string, fingerprint int, ids int, _extra string"
SF = "/root/testdata/sf0.001"


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = ["the", "of", "and", *("".join(rng.choice("abcdefgh éñ").strip() or "x" for _ in range(rng.randint(2, 6))) for _ in range(300))]
    base = words(rng, 120, vocabulary)
    passage = words(rng, 60, vocabulary)
    texts = [base, base, base + " tail", base.replace("the", "a", 1), passage, f"start {passage} end", words(rng, 40, vocabulary) + " " + passage, None, "", " \n\t ", "one", "one two three", "!!!", words(rng, 4000, vocabulary), "ab " * 3000, "x" * 5000]
    texts += [words(rng, rng.randint(1, 200), vocabulary) for _ in range(60)]
    texts += [f"key token = '{'ab12' * 8}' and AKIA{'Q' * 16} secret=no password: hunter22", "secret=token:abcdef x AKIAAKIA1 " + "f" * 24 + "g" + "e" * 23]
    out = [(i, t, None if i % 9 == 0 else "en", "clash", 1, 2, "e") for i, t in enumerate(texts)]
    return [*out, out[0], out[5], (None, "orphan of the row", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def many(it):
    return collections.Counter(it)


def hash_of(b):
    return hashlib.sha256(b).hexdigest()


# ---- 1
def spans_of(t):
    assign = re.compile(secrets.BASE[0].pattern, re.ASCII)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(docs, rows, none):
    got = secrets.scan(docs).collect()
    own = many((r.doc_id, tuple((s.start, s.kind, s.end) for s in r.spans if s.kind < 3)) for r in got)
    assert own == many((r[0], tuple(spans_of(r[1] or ""))) for r in rows)
    assert secrets.scan(none).count() == 0
    clean = docs.join(secrets.scan(docs).where(F.size("spans") > 0).distinct(), "doc_id").select(secrets.redact(F.col("text"), F.col("spans")).alias("t")).first().t
    assert not spans_of(clean)


def test_ledger_scans_unseen_pairs_only(spark, docs, tmp_path):
    root = f"file://{tmp_path}/ledger"
    ledger = secrets.BlobLedger(spark, root)
    blobs = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert ledger.commit(docs, "v1") == blobs and ledger.commit(docs, "v2") == 0
    more = spark.createDataFrame([(1000, "new token = abcdefgh"), (1001, "one")], "doc_id long, text string")
    assert ledger.commit(more, "v3") == 1
    assert {r.doc_id: len(r.spans) for r in ledger.report("v3").collect()} == {1000: 1, 1001: 0}
    assert ledger.report("v1").count() == docs.count()
    assert secrets.BlobLedger(spark, root, secrets.BASE).commit(more, "v4") == 2  # other rules: all pairs are new


def test_a_repeated_commit_changes_nothing(docs, tmp_path):
    ledger = secrets.BlobLedger(docs.sparkSession, f"file://{tmp_path}/ledger")
    ledger.commit(docs, "v 1/a")
    first = many((r.doc_id, r.blob, str(r.spans)) for r in ledger.report("v 1/a").collect())
    assert ledger.commit(docs, "v 1/a") == 0
    assert many((r.doc_id, r.blob, str(r.spans)) for r in ledger.report("v 1/a").collect()) == first


def test_secret_query(spark):
    got = {r.doc_id: r for r in queries.op1_secrets(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        s = spans_of(r.text or "")
        joined = ",".join(f"{secrets.BASE[k].kind}:{a}:{b}" for a, k, b in s)
        g = got[r.doc_id]
        assert (g.base_sha256, g.n_assign, g.n_access, g.n_hex) == (hash_of(joined.encode()), *(sum(k == i for _, k, _ in s) for i in range(3)))


# ---- 2
@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe(docs, rows, none, reference_tokenizer):
    got = many((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode_decode(docs, queries.tokenizer_path()).collect())
    want = collections.Counter()
    for r in rows:
        ids = reference_tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], np.array(ids, "<u4").tobytes(), reference_tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe.encode_decode(none, queries.tokenizer_path()).count() == 0


def test_bpe_is_exact_on_odd_texts(reference_tokenizer):
    model = bpe.PrefixBpe(open(queries.tokenizer_path(), encoding="utf-8").read())
    rng = random.Random(0)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "don't we'll I'M 's", "\x1c \x85 y", "🙂🙂 ñandú", "a" * 3000, " " * 99 + "a", "\r\n\r\n\t x"]
    texts += ["".join(rng.choice(a) for _ in range(rng.randint(1, 50))) for a in ("ab", "the nd in er", "0123 4", "éèñ aé", "中文 a", "=-_*# \n") for _ in range(60)]
    for t in texts:
        ids = reference_tokenizer.encode(t, add_special_tokens=False).ids
        packed = model.encode_packed(t)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert model.decode_packed(packed) == reference_tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_refuses_files_it_cannot_follow():
    import json

    spec = json.load(open(queries.tokenizer_path(), encoding="utf-8"))
    for change in (lambda s: s["model"].update(ignore_merges=True), lambda s: s["added_tokens"].append({"id": 0, "content": "x", "lstrip": True})):
        bad = json.loads(json.dumps(spec))
        change(bad)
        with pytest.raises(ValueError, match="supported"):
            bpe.PrefixBpe(json.dumps(bad))


# ---- 3
def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(fps, threshold):
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= threshold:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in root}


def test_simhash(docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    assert many((r.doc_id, r.fp % (1 << 64)) for r in got) == many((r[0], fingerprint(r[1] or "")) for r in rows)
    fps = {r[0]: fingerprint(r[1] or "") for r in rows if r[0] is not None}
    want = components(sorted(fps.items()), 4)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert simhash.near_duplicates(none).count() == 0


def test_the_largest_id_names_its_component(spark):
    top = (1 << 63) - 1
    rows = [(top, "a b c d e"), (None, "a b c d e"), (top, "other words stand here now"), (None, "nobody else has these words"), (-5, "x y z")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(top, top), (None, top), (None, None), (-5, -5)}


def test_links_find_all_pairs(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    want = components(list(enumerate(fps)), 4)
    for tile in (4096, 7):  # also with anchors dealt out in tiles
        roots = {r.node: r.component for r in simhash.connected_components(simhash.links(nodes, 4, tile)).collect()}
        assert {i: roots.get(i, i) for i in range(len(fps))} == want


def test_links_of_two_lanes_leave_out_no_pair(spark, monkeypatch):
    """Pairs whose 25 differing bits lie anywhere, also over three in each of the parts there were."""
    import random

    rng, rows = random.Random(5), []
    spread = [b for lo, size in ((0, 21), (21, 21), (42, 22), (64, 21), (85, 21), (106, 22)) for b in range(lo, lo + size, 5)]  # 4 or 5 bits of each
    for n in range(120):
        x = rng.getrandbits(128)
        bits = rng.sample(spread, 25) if n < 60 else rng.sample(range(128), 25 if n % 2 else 26)
        y = x
        for b in bits:
            y ^= 1 << b
        rows += [x, y]
    rows += [rows[0] ^ 1 << b for b in range(100)]  # a crowd about one
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v & (1 << 64) - 1), signed(v >> 64), i) for i, v in enumerate(rows)], "fp long, fp1 long, rep long")
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(rows):
        for j in range(i):
            if (x ^ rows[j]).bit_count() <= 25:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for tile in (simhash.TILE, 8):
        got = {r.node: r.component for r in simhash.connected_components(simhash.links(nodes, 25, tile)).collect()}
        assert got == {i: find(i) for i in range(len(rows)) if find(i) != i}
    # some of these differ by three bits or more in each of six parts, where the stage once looked for two
    six = ((0, 21), (21, 21), (42, 22), (64, 21), (85, 21), (106, 22))
    assert any(all(((rows[2 * n] ^ rows[2 * n + 1]) >> at & (1 << size) - 1).bit_count() > 2 for at, size in six) for n in range(60))
    prints = nodes.selectExpr("rep as doc_id", "fp", "fp1", "cast(rep as string) as blob")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **b: prints)
    assert {r.doc_id for r in simhash.heads(prints).collect()} == {find(i) for i in range(len(rows))}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 99), (99, 98), (7, 7)]
    roots = {r.node: r.component for r in simhash.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(1, 61)} | {99: 98, 100: 98}


# ---- 4
MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def commented(text, lead, head="", tail=""):
    return head + "".join(f"{lead}{line}".rstrip() + "\n" for line in text.split("\n")) + tail


def test_licenses(spark, none):
    whole = {"MIT": (MIT, "full text"), "Apache-2.0": (APACHE, "header"), "BSD-3-Clause": (BSD, "text"), "GPL-3.0-or-later": (GPL, "text"), "MPL-2.0": (MPL, "full notice")}
    rows, want = [], set()
    for n, (name, (text, rule)) in enumerate(whole.items()):
        forms = [text, commented(text, "# "), commented(text, " * ", "/*\n", " */\nint x;\n"), commented(text, "// "), commented(text, "; "), re.sub(r"(?<!\n)\n(?!\n) *", " ", text), "Prose before.\n\n" + text.replace("\n", "\r\n") + "\nprose after"]
        rows += [(100 * n + i, f) for i, f in enumerate(forms)]
        want |= {(100 * n + i, name, rule) for i in range(len(forms))}
    got = {(r.doc_id, r.license, r.rule) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_license_edges(spark, docs, none):
    dashes = "-" * 200_000
    rows = [(1, "a. b.\nReleased under the MIT License.\nmore"), (2, f"Released under the MIT License {dashes}"), (3, "not released under the MIT license plates"), (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0."), (6, "This work is licensed under the GNU General Public License, version 3."), (7, "license " * 50_000), (8, "a title\nLicensed under CC BY-NC 4.0.\nb"), (None, "SPDX-License-Identifier: Apache-2.0\n"), (9, ". ;:\n " * 50_000 + "license")]
    rows += [rows[0]]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, n int")
    got = sorted(((r.doc_id or 0, r.license, r.rule, r.n, r.first) for r in licenses.scan(table).collect()))
    assert got == [(0, "Apache-2.0", "tag", 1, 0), (1, "MIT", "notice", 1, 2), (2, "MIT", "notice", 1, 0), (6, "CC-BY-NC-4.0", "notice", 1, 1), (6, "GPL-3.0", "notice", 1, 0), (8, "CC-BY-NC-4.0", "notice", 1, 0)]
    assert licenses.scan(none).count() == 0 and licenses.scan(docs).count() == 0


def test_every_known_sentence_passes_the_sign():
    sign = re.compile(licenses.SIGNS.removeprefix("(?iu)").replace(r"\P{L}", r"\W"), re.I)
    for words, _ in licenses.sequences():
        assert sign.search(words), words
    assert {s for r in licenses.RULES for s in r.sentences} <= set(licenses.SENTENCES)


def test_license_query_finds_planted_lines(spark):
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    want = {(r.doc_id, name) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for line, name in lines.items() if line in r.text.split("\n")}
    assert want <= {(r.doc_id, r.license) for r in queries.op4_licenses(spark, SF).collect()}


# ---- 5
def test_language(spark):
    got = queries.op5_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98


def test_language_model_is_kernel_ridge_regression():
    """Scores against the plain kernel, its Nystroem map and the normal equations, all written out."""
    rng = random.Random(6)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 60))) for letters in ("abcd ", "cdef ", "жзик ") for _ in range(12)]
    labels = [x for x in ("p", "q", "r") for _ in range(12)]

    def ngrams(t):
        t = " " + re.sub(r"[^\w]+", " ", t.lower()).strip() + " " if t.strip() else " "
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    sets = [langid.grams(t) for t in texts]
    assert [len(s) for s in sets] == [len(ngrams(t)) for t in texts]
    plain = np.array([[len(ngrams(a) & ngrams(b)) / (len(ngrams(a)) * len(ngrams(b))) ** 0.5 for b in texts] for a in texts])
    model = langid.train(sets, labels, landmarks=15)
    chosen = [i for k in range(3) for i in range(12 * k, 12 * k + 5)]
    values, vectors = np.linalg.eigh(plain[np.ix_(chosen, chosen)])
    x = plain[:, chosen] @ (vectors / np.sqrt(np.maximum(values, 1e-6 * values.max())))
    y = np.array([[1.0 if a == b else -1.0 for b in "pqr"] for a in labels])
    w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + 1e-2 * len(x) * np.eye(15), (x - x.mean(0)).T @ (y - y.mean(0)))
    assert np.allclose(model.scores(sets), (x - x.mean(0)) @ w + y.mean(0), atol=2e-3)


def test_language_sample_is_bounded_and_leaves_no_language_out(spark):
    rows = [(i, f"text {i} of {i % 300}", f"l{i % 300}") for i in range(1200)] + [(i, None, "none") for i in range(5)] + [(9, "twice the same", "l1")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sets, labels = langid.sample(docs, 400, 600, "doc_id", "text", "lang")
    assert collections.Counter(labels) == {f"l{i}": 2 for i in range(300)} and len(sets) == 600
    assert len(langid.sample(docs, 400, 100, "doc_id", "text", "lang")[1]) == 300


def test_language_edges(docs, rows, none):
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    texts = {r[0]: r[1] for r in rows}
    assert all((got[d][0] == "und") == (not t or not re.search(r"[^\W\d_]", t)) for d, t in texts.items())
    assert langid.fit(none) is None and langid.predict(none, None).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    kept = {r.doc_id for r in langid.accepted(docs).collect()}
    assert kept == {d for d, t in texts.items() if t and re.search(r"[^\W\d_]", t)}


# ---- 6
def test_spot_signatures():
    a = "The boiler of the house was serviced and the old pump of the cellar is loud"
    assert np.array_equal(spotsigs.signatures(a), spotsigs.signatures(a)) and len(spotsigs.signatures("one"))
    assert spotsigs.jaccard(spotsigs.signatures(a), spotsigs.signatures(a.upper())) == 1.0
    empty = spotsigs.signatures(" .. ")
    assert spotsigs.jaccard(empty, empty) == 1.0 and spotsigs.jaccard(empty, spotsigs.signatures(a)) == 0.0
    rng = np.random.default_rng(0)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint32) for _ in range(2))
        j = len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y))) if len(x) or len(y) else 1.0
        assert spotsigs.jaccard(x, y) == j and spotsigs.jaccard(x, y, 0.4) == (j if j >= 0.4 else 0.0)


def test_next_documents(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)

    def each(ids, own, following):
        import pyarrow as pa

        return pa.table({"doc_id": pa.array(ids, pa.int64()), "own": pa.array(own, pa.string()), "next": pa.array(following, pa.string())})

    got = many((r.doc_id, r.own, r.next) for r in spotsigs.with_next(docs, "doc_id long, own string, next string", each).collect())
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (-((1 << 62) - 1 if x[0] is None else x[0]), x[1].encode()))
    assert got == many((d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order))


@pytest.mark.parametrize("tile", [2048, 2])
def test_spot_pairs(spark, docs, rows, none, tile):
    more = [(200 + i, "the old boiler of the house was serviced in may and " + f"again {i} in june by the men of the town", *rows[0][2:]) for i in range(9)]
    more += [(None, "a text that nobody else has but the other row without an id", *rows[0][2:])] * 2
    pairs, members = spotsigs.near_pairs(docs.unionByName(spark.createDataFrame(more, SCHEMA)), 0.6, tile=tile)
    table = [*rows, *more]
    prints = [tuple(spotsigs.signatures(r[1] or "").tolist()) for r in table]
    by = collections.defaultdict(list)
    for r, p in zip(table, prints, strict=True):
        by[p].append(r[0])
    rep = {p: min((d for d in ids if d is not None), default=None) for p, ids in by.items()}
    assert many((r.doc_id, r.rep) for r in members.collect()) == many((r[0], rep[p]) for r, p in zip(table, prints, strict=True))
    named = {getattr(r, "class"): r.rep for r in members.collect()}
    assert len(named) == len(by)
    heads = [p for p in by if p]
    want = many(frozenset((rep[p], rep[q])) for i, p in enumerate(heads) for q in heads[:i] if spotsigs.jaccard(np.array(p), np.array(q)) >= 0.6)
    assert many(frozenset((named[r.a], named[r.b])) for r in pairs.collect()) == want and want
    assert spotsigs.near_pairs(none)[0].count() == 0


def test_spot_query(spark):
    """The registered query against the definition of its columns."""
    got = {r.doc_id: r for r in queries.op6_spotsigs(spark, SF).collect()}
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: -r.doc_id)
    assert len(got) == len(docs)
    for i, r in enumerate(docs):
        text, following = r.text or "", docs[(i + 1) % len(docs)].text or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        prints = [set(spotsigs.signatures(t).tolist()) for t in (text, edited, following)]
        near = [len(prints[0] & p) / len(prints[0] | p) if prints[0] | p else 1.0 for p in prints[1:]]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(text), hash_of(edited.encode()))
        assert [g.fingerprint, g.edited_fingerprint] == ["".join(f"{c:08x}" for c in sorted(p)) for p in prints[:2]]
        assert [g.near_edited, g.near_next] == [x if x >= queries.LEAST_LIKENESS else 0.0 for x in near]


# ---- 7
def test_substrings(docs, rows, none):
    for width in (1, 3, 13):
        first: dict = {}
        last = lambda d: (1 << 63) if d is None else d
        for d, t, *_ in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            for i in range(len(w) - width + 1):
                key = tuple(w[i : i + width])
                first[key] = min(first.get(key, last(d)), last(d))
        want = collections.Counter()
        for d, t, *_ in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < last(d) for j in range(i, i + width)}
            want[d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
        got = substrings.remove_repeats(docs, width).collect()
        assert many((r.doc_id, r.n_words, sum(x.end - x.start for x in r.removed), r.kept) for r in got) == want
    assert substrings.remove_repeats(none).count() == 0


def test_many_bundles_and_shelves(docs, monkeypatch):
    """The same rows, whatever the number of bundles and the steps of the exchange."""
    from corpus_engine.llm import common

    form = lambda df: many(str(r) for r in df.collect())
    seven, eight = form(substrings.remove_repeats(docs, 3)), form(runindex.remove_repeats(docs, 20))
    for module in (substrings, runindex):
        monkeypatch.setattr(module, "bundled", lambda rows, target_bytes=0: common.bundled(rows, target_bytes=2500))
    assert common.bundled(common.texts(docs), target_bytes=2500)[1] > 20
    for shelf in (1, 4):
        assert form(substrings.remove_repeats(docs, 3, shelf=shelf)) == seven
    assert form(runindex.remove_repeats(docs, 20)) == eight


# ---- 8
def strings_gone(rows, length):
    count = collections.Counter(b[i : i + length] for r in rows for b in [(r[1] or "").encode()] for i in range(len(b) - length + 1))
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield r[0], b, gone


@pytest.mark.parametrize(("length", "crowd"), [(20, 2048), (60, 2048), (60, 1)])
def test_runindex(docs, rows, none, length, crowd):
    want = collections.Counter()
    for d, b, gone in strings_gone(rows, length):
        want[d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, y in zip(b, gone, strict=True) if not y)] += 1
    got = runindex.remove_repeats(docs, length, crowd).collect()
    assert many((r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), bytes(r.kept)) for r in got) == want
    assert runindex.remove_repeats(none).count() == 0


def test_matching_statistics():
    rng = random.Random(0)
    for _ in range(40):
        letters = rng.choice([b"ab", b"abc", b"\0a", bytes(range(97, 110))])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3)]
        pieces = [b[rng.randint(0, len(b)) :] + bytes(rng.choice(letters) for _ in range(rng.randint(1, 15))) for b in rng.choices(base, k=6)]
        index = runindex.RunIndex(pieces)
        got = index.statistics()
        for p, x in enumerate(pieces):
            for i in range(len(x)):
                best = max((next((n for n in range(min(len(x) - i, len(y) - j)) if x[i + n] != y[j + n]), min(len(x) - i, len(y) - j)) for q, y in enumerate(pieces) for j in range(len(y)) if (p, i) != (q, j)), default=0)
                assert got[index.start[p] + i] == best


# ---- 9
def test_decontamination(spark, none):
    question = "A farmer has {a} apples and gives {b} apples to {n} before she walks {c} km to the old market town."
    fill = lambda a, b, n, c: question.format(a=a, b=b, n=n, c=c)
    rows = [(1, "x y z. " + fill(12, 5, "Maria", 12) + " end"), (2, fill(30, 7, "Clara", 30)), (3, fill(30, 7, "Clara", 31)), (4, fill(12, 5, "Maria", 12).upper()), (5, None), (6, ""), (7, "the old market town has nothing"), (8, fill("3.5", "1,200", "Jo", "3.5")), (9, fill(12, 5, "Maria", 12)[:60]), (1, "x y z. " + fill(12, 5, "Maria", 12)), (None, fill(12, 5, "Maria", 12))]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, fill(12, 5, "Maria", 12)), (2, "short one"), (3, None), (4, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(d, 1) for d in (1, 2, 4, 8, None)}
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {3, 5, 6, 7, 9}
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_of_names_at_sentence_starts_and_of_short_items(spark):
    question = "{n} has {a} apples. {n} gives {b} apples to Anna. How many apples does {n} have left?"
    fill = lambda n, a, b: question.format(n=n, a=a, b=b)
    rows = [(1, "x y. " + fill("Bob", 9, 4)), (2, fill("Bob", 9, 9).replace("Bob gives", "Tim gives")), (3, "so\n" + fill("Tom", 5, 2)), (4, "They asked: who wrote HAMLET? Nobody knew."), (5, "Who wrote Macbeth?"), (6, "Now what is 2+2?"), (7, "What is 2+3?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, fill("Tom", 5, 2)), (2, "Who wrote Hamlet?"), (3, "What is 2+2?"), (5, "Who wrote Hamlet?")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.containment) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1, 1.0), (3, 1, 1.0), (4, 2, 1.0), (4, 5, 1.0), (6, 3, 1.0)}
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {2, 5, 7}


def test_slots_are_filled_one_to_one(spark):
    fill = "Mary carried {} apples and {} pears from the old barn to the market.".format
    docs = spark.createDataFrame([(1, fill(4, 4)), (2, fill(8, 9)), (3, fill(5, 3)), (4, "and so " + fill(3, 5).lower()), (5, fill("\u0663", "\u0665"))], "doc_id long, text string")
    items = spark.createDataFrame([(1, fill(3, 5))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).collect()} == {2, 3, 4, 5}


def test_decontamination_query_finds_planted_passages(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text.lower() in d.text.lower()}
    assert {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, SF).collect()} == want and want


# ---- 10
def test_sharding(docs, rows, none):
    out = sharding.shard(docs, shards=5).collect()
    assert many((r.doc_id, r["size"], r.text_crc32) for r in out) == many((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in range(5):
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.shard(none, 5).count() == 0


def test_splitters_are_near_equal(spark):
    rng = random.Random(1)
    rows = [(rng.choice([5, rng.getrandbits(62)]), rng.randint(1, 100)) for _ in range(5000)]
    df = spark.createDataFrame(rows, "k long, w long").where("k <> 5")
    rows = [r for r in rows if r[0] != 5]
    cuts, rounds = sharding.histogram_splitters(df, 40, 0.01)
    total = sum(w for _, w in rows)
    for i, c in enumerate(cuts):
        assert abs(sum(w for k, w in rows if k < c) - total * (i + 1) / 40) <= max(0.01 * total / 40, 100)
    assert cuts == sorted(cuts) and rounds >= 2
    assert sharding.histogram_splitters(spark.createDataFrame([(5, 1)] * 10, "k long, w long"), 4, 0.1)[0] == sorted(sharding.histogram_splitters(spark.createDataFrame([(5, 1)] * 10, "k long, w long"), 4, 0.1)[0])


def test_law_of_equal_bytes(spark):
    rng = random.Random(4)
    rows = [(i, "copy of one text " * 9 if i % 3 == 0 else "x" * rng.randint(0, 400)) for i in range(6000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    held = collections.Counter()
    for r in out:
        held[r.shard] += r["size"]
    mean = sum(held.values()) / 40
    assert len(held) == 40 and max(abs(n - mean) for n in held.values()) <= 2 * (0.002 * mean + max(r["size"] for r in out))


def test_many_splitters_need_no_python(spark, docs, monkeypatch):
    from corpus_engine.llm.common import cell_of, one_of

    rng = random.Random(8)
    cuts = sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(1000)})
    keys = [*cuts, *(c - 1 for c in cuts), -(1 << 63), (1 << 63) - 1]
    found = spark.createDataFrame([(k,) for k in keys], "k long").select("k", cell_of(F.col("k"), cuts).alias("n"), one_of(F.col("k"), cuts).alias("one"))
    assert all(r.n == sum(c <= r.k for c in cuts) and r.one == (r.k in set(cuts)) for r in found.collect())
    monkeypatch.setattr(sharding, "PIECE_ROWS", 1)
    plan = sharding.shard(docs, 3)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan and "Generate" not in plan


def test_large_shards_are_cut_in_pieces(docs, monkeypatch):
    whole = {(r.doc_id, r["size"]): 1 for r in sharding.shard(docs, 3).collect()}
    monkeypatch.setattr(sharding, "PIECE_ROWS", 7)
    out = sharding.shard(docs, 3).collect()
    assert {(r.doc_id, r["size"]): 1 for r in out} == whole
    for s in range(3):
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))
