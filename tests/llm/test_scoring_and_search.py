import hashlib
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from metrilith.llm import collision_ann, gam_quality, license_rules, queries, wu_manber


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    got = queries.op5_quality_classifier(spark, sf).collect()
    assert len(got) == 10_000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    pairs = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(pairs) > 500 and np.mean([a == b for a, b in pairs]) > 0.98


def test_scores_of_odd_texts(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (9, 0), (None, 1)], "doc_id bigint, quality int")
    model = gam_quality.train(odd_docs, labels)
    out = gam_quality.score(odd_docs, model, out="fresh").collect()
    assert len(out) == odd_docs.count() and all(0 <= r.fresh <= 1 for r in out) and "node" in out[0].asDict()
    assert gam_quality.score(no_docs, model, out="fresh").count() == 0
    empty = gam_quality.train(no_docs, labels)
    assert empty.score(np.zeros((2, len(gam_quality.FEATURES)))).tolist() == [0.5, 0.5]


def test_pairs_of_features_are_learnt():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(gam_quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = gam_quality.AdditiveModel.fit(x[:3000], y[:3000])
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.9


def brute_hits(text, items, m=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words = find(text)
    hit, seen = set(), set()
    for item_id, t in items:
        own = find(t)
        k = min(m, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(words) - k + 1) if k else ():
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                seen.add(item_id)
    return len(words), len(hit), len(seen), hashlib.sha256(",".join(sorted(map(str, seen))).encode()).hexdigest()


def test_decontamination_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' where doc_id % 2 = 0 or doc_id in (select doc_id from '{sf}/documents.parquet')").fetchall()
    got = {r.doc_id: r for r in queries.op7_decontamination(spark, sf).collect()}
    assert sum(r.contaminated for r in got.values()) > 0
    for i, text in rows[:400]:
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute_hits(text, items) and r.contaminated == (r.n_hit > 0)


def test_decontamination_with_one_and_several_sets_of_tables(spark, odd_docs, no_docs):
    items = [(1, "lazy dog the quick brown fox jumps over the lazy dog"), (2, "ONE"), (3, None), (4, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15"), (4, "text with a"), (5, "8 9 1 2"), (11, "word0")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((r.doc_id or 0, *brute_hits(r.text, items)) for r in odd_docs.collect())
    for limit in (1 << 20, 2, 5):
        got = wu_manber.decontaminate(odd_docs, bench, windows=limit)
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got.collect()) == want
        counted = wu_manber.with_hits(odd_docs, bench, out="hits", windows=limit)
        assert counted.columns == [*odd_docs.columns, "hits"]
        assert sorted((r.doc_id or 0, r.hits) for r in counted.collect()) == [(x[0], x[2]) for x in want]
        assert all(sum(h["last"] - h["first"] + 1 for h in r.hits) == r.n_hit for r in got.collect())
        assert wu_manber.decontaminate(no_docs, bench, windows=limit).count() == 0
    assert wu_manber.decontaminate(odd_docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_long_items_are_cut_without_losing_windows():
    rng = np.random.default_rng(3)
    words = [b"w%d" % k for k in rng.integers(0, 50, 400)]
    text = b" ".join(words)
    for m in (1, 2, 3, 10):
        for longest in (1, 7, 1000):
            cut = wu_manber.stretches_of(9, text, m, longest)
            assert all(len(w) <= longest + m - 1 for *_, w in cut)
            own = [tuple(w[k : k + m]) for *_, w in cut for k in range(len(w) - m + 1)]
            assert own == [tuple(words[k : k + m]) for k in range(len(words) - m + 1)]
            (found,) = wu_manber.matchers(cut)
            other = [b"w%d" % k for k in rng.integers(0, 50, 300)] + words[100:120] + [b"unknown"] + words[:m]
            want = [k for k in range(len(other) - m + 1) if tuple(other[k : k + m]) in set(own)]
            assert [at for at, ids in found.occurrences(other) if ids == (9,)] == want


def test_scores_against_plain_sums(spark, small):
    """Scores are sums of looked-up numbers, found bin by bin."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = gam_quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert model.tables and model.pairs
    place = lambda edges, v: sum(e <= v for e in edges)
    for r in gam_quality.score(docs, model).collect():
        x = gam_quality.features((r.text or "").encode())
        f = model.intercept + sum(t[place(e, v)] for t, e, v in zip(model.tables, model.edges, x, strict=True))
        f += sum(t[place(model.pair_edges[a], x[a]), place(model.pair_edges[b], x[b])] for a, b, t in model.pairs)
        assert abs(r.score - 1 / (1 + np.exp(-f))) < 1e-9


def brute_nearest(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[ids == ids[i]] = -np.inf
        best = np.lexsort((ids, -s))[:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in best if s[j] > -np.inf]
    return out


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    want = brute_nearest(np.asarray([r[0] for r in rows]), np.asarray([r[1] for r in rows], np.float64))
    got = {}
    for r in queries.op8_nearest_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    for q, own in got.items():
        assert len(own) == 20 and own == sorted(own, key=lambda r: (-r[1], r[0]))
        exact = dict(want[q])
        hits += len(exact.keys() & {v for v, _ in own})
        assert all(abs(s - exact[v]) < 1e-12 for v, s in own if v in exact)
    assert hits / 20 / len(want) >= 0.9


def test_repeated_queries_answer_once(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(40)]
    rows += [rows[0], rows[0], rows[7]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = collision_ann.nearest(df, df.filter("vec_id = 0")).orderBy("rank").collect()
    score = {k: float(np.dot(v, rows[0][1])) for k, v in rows}
    want = sorted([(-score[k], k) for k, _ in rows if k])[:20]
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, n, k) for n, (_, k) in enumerate(want, 1)]


@pytest.mark.parametrize("clusters", [0, 300])
def test_recall_of_full_blocks(clusters):
    """One full block, vectors in all directions or in clusters: at least nine in ten."""
    import pandas as pd

    rng = np.random.default_rng(6)
    x = rng.standard_normal((collision_ann.BLOCK, 64))
    if clusters:
        x = 0.5 * x + 2 * rng.standard_normal((clusters, 64))[rng.integers(0, clusters, len(x))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    asked = ids[::400]
    pdf = pd.concat([pd.DataFrame({"vec_id": ids, "v": list(x), "is_query": False}), pd.DataFrame({"vec_id": asked, "v": list(x[asked]), "is_query": True})])
    got = collision_ann._search(20, 1.0, collision_ann.VERIFIED)(pdf).groupby("query_id").vec_id.apply(set)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -9
    best = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(got[q] & set(b)) / 20 for q, b in zip(asked, best, strict=True)]) >= 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (20, [1.0, 1.0]), (None, [9.0, 9.0]), (40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 0, 0.5) for r in rows], "vec_id bigint, embedding array<double>, rank int, score double")
    got = [tuple(r) for r in collision_ann.nearest(df, df.filter("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (20, 1, 1, 2.0), (20, 2, 0, 1.0), (20, 3, 2, 1.0)]
    assert collision_ann.nearest(df.limit(0), df).count() == 0 and collision_ann.nearest(df, df.limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2020 A. Person

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
SOFTWARE."""

BSD = """Copyright (c) 2020, A. Person. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may
   be used to endorse or promote products derived from this software without
   specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."""

GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>."""

APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""

MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""

ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT."""


def test_licences_of_standard_texts(spark):
    """Whole texts as they are published, joined to one line, and as comments of three languages."""
    whole = {"MIT": MIT, "BSD-3-Clause": BSD, "GPL-3.0-or-later": GPL, "Apache-2.0": APACHE, "MPL-2.0": MPL, "Zlib": ZLIB, "ISC": ISC}
    whole["BSD-2-Clause"] = re.sub(r"(?s)3\. Neither.*?permission\.\n", "", BSD)
    whole["LGPL-3.0-or-later"] = GPL.replace("GNU General", "GNU Lesser General")
    whole["AGPL-3.0-or-later"] = GPL.replace("GNU General", "GNU Affero General")
    rows, want = [], {}
    for name, text in whole.items():
        for k, form in enumerate((text, " ".join(text.split()), re.sub("(?m)^", "# ", text), "/*\n" + re.sub("(?m)^", " * ", text) + "\n */", re.sub("(?m)^", "// ", text) + "\r\nint main();")):
            rows.append((len(rows), "Some words before.\n\n" + form))
            want[rows[-1][0]] = (k, [name])
    for tag, names in (("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]), ("# SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), ("/* SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 */ x", []), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["Apache-2.0", "MIT"]), ("SPDX-License-Identifier: GPL-3.0", ["GPL-3.0-only"]), ("SPDX-License-Identifier: Made-Up", [])):
        rows.append((len(rows), tag))
        want[rows[-1][0]] = (tag, names)
    got = {r.doc_id: r for r in license_rules.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, (form, names) in want.items():
        assert got[k].licenses == names, (form, rows[k][1], got[k].license_sentences)
    # rules of whole texts fire, not only those of one sentence
    for name, rule in license_rules.RULES:
        if len(rule) > 2 and name in whole:
            ids = next(got[k].license_sentences for k in want if want[k] == (0, [name]))
            rest = iter(ids)
            if name in ("MIT", "Apache-2.0", "Zlib", "ISC") or len(rule) > 3:
                assert all(x in rest for x in rule), (name, ids)


def test_every_known_sentence_is_hinted_and_found(spark):
    rows = list(enumerate(license_rules.SENTENCES))
    got = {r.doc_id: r.license_sentences for r in license_rules.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    used = {x for _, rule in license_rules.RULES for x in rule}
    for k, sentence in rows:
        assert license_rules.SENTENCES[sentence] in got[k], sentence
    assert used - {f"spdx-{x.lower()}" for x in license_rules.SPDX} <= set(license_rules.SENTENCES.values())


def test_licence_scan_against_plain_loops(spark):
    """Sentences and rules found one by one; the documents hold no comments or wrapped licences."""
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries.op9_license_scan(spark, sf).collect()}
    assert len(got) == len(rows) and sum(r.licenses != "" for r in got.values()) > 10
    for i, text in rows:
        plain = " " + re.sub("[^a-z0-9]+", " ", text.lower()) + " "
        if not re.search(license_rules._HINT.replace("(?i)", "(?i:") + ")", text):
            assert got[i].sentence_ids == ""
            continue
        hits = sorted((m.start(), -len(s), s) for s in license_rules.SENTENCES for m in re.finditer(f"(?= {re.escape(s)} )", plain))
        ids, end = [], 0
        for at, size, s in hits:
            if at >= end:
                ids.append(license_rules.SENTENCES[s])
                end = at - size
        assert got[i].sentence_ids == ",".join(ids), text[:200]
        names = []
        for name, rule in license_rules.RULES:
            rest = iter(ids)
            if name not in names and all(x in rest for x in rule):
                names.append(name)
        for name, others in license_rules.YIELDS.items():
            if set(names) & set(others):
                names = [x for x in names if x != name]
        assert got[i].licenses == ",".join(names)


def test_licences(spark, odd_docs, no_docs):
    rows = [
        (1, "Some words.\nLicensed under the Apache License, Version 2.0."),
        (2, "Released under the MIT License. More prose. All rights reserved."),
        (3, "All rights reserved."),
        (4, "A licence to kill is no licence."),
        (5, None),
        (6, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ]
    got = {r.doc_id: (r.license_sentences, r.licenses) for r in license_rules.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (["apache-2-notice"], ["Apache-2.0"]), 2: (["mit-notice", "rights-reserved"], ["MIT"]), 3: (["rights-reserved"], ["Proprietary"]), 4: ([], []), 5: ([], []), 6: (["bsd-3-names"], [])}
    assert license_rules.scan(odd_docs).filter("size(licenses) > 0").count() == 0 and license_rules.scan(no_docs).count() == 0


def test_licence_rules_over_very_many_known_sentences(spark):
    known = {name: text for text, name in license_rules.SENTENCES.items()}
    some = " ".join(known[x].capitalize() + "." for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-3-names", "bsd-warranty"))
    texts = [(1, some * 400), (2, some * 400 + " " + known["bsd-liability"].capitalize() + "."), (3, some * 400)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    license_rules.scan(docs).collect()
    began = time.time()
    got = {r.doc_id: (len(r.license_sentences), r.licenses) for r in license_rules.scan(docs).collect()}
    assert time.time() - began < 4
    assert got == {1: (2000, ["BSD-3-Clause"]), 2: (2001, ["BSD-3-Clause"]), 3: (2000, ["BSD-3-Clause"])}
    with pytest.raises(ValueError, match="exist"):
        license_rules.scan(docs.withColumn("licenses", F.lit("own")))
