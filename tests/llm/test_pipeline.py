"""Each stage of the pipeline against a plain version over its own input."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metrilith.llm import gam_quality
from metrilith.llm.common import materialise, table
from test_extraction_and_pii import brute as spans_of
from test_scoring_and_search import brute_hits
from test_tokens_and_packing import check_packed

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each."""
    out = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), "stage"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "pii", "best-fit packing"]


def test_quality(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    model = gam_quality.train(stages[0], table(spark, SF, "labels"))
    for i, r in before.items():
        score = float(model.score(np.asarray([gam_quality.features(r.text.encode())]))[0])
        assert (i in after) == (score >= 0.3)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    held = [i for i in before if i in labels and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(i in after for i in held if labels[i]) and np.mean([i not in after for i in held if not labels[i]]) > 0.8


def test_near_duplicates(stages):
    before, after = rows(stages[1]), rows(stages[2])
    ids = sorted(before)
    words = {i: (before[i].text or "").lower().split() for i in ids}
    own = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    where = defaultdict(list)
    for i in ids:
        for s in own[i]:
            where[s].append(i)
    label = {i: i for i in ids}
    pairs = {(a, b) for l in where.values() if len(l) < 300 for b in l for a in l if a < b}
    near = [(a, b) for a, b in sorted(pairs) if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])]
    for _ in range(12):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    want = {i for i in ids if label[i] == i}
    # nothing clean goes, one of each group of copies stays, at most a few borderline copies are left
    assert want <= set(after)
    assert len(set(after) - want) <= 0.05 * (len(ids) - len(want)) + 1
    texts = [" ".join(words[i]) for i in after]
    assert len(texts) == len(set(texts))
    assert all(after[i] == before[i] for i in after)


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    before, after = rows(stages[2]), rows(stages[3])
    for i, r in list(before.items())[:300]:
        assert (i in after) == (brute_hits(r.text, items)[1] == 0)
    assert set(after) < set(before)


def test_personal_data(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert before.keys() == after.keys()
    changed = 0
    for i, r in before.items():
        if spans_of(r.text):
            assert not spans_of(after[i].text) and re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", after[i].text)
            assert after[i].n_chars == len(after[i].text)
            changed += 1
        elif "[" not in after[i].text:
            assert after[i] == r
    assert changed > 0


def test_packing(stages):
    docs = [(r.doc_id, r.text) for r in stages[4].collect()]
    bins, tokens = check_packed(stages[5].collect(), docs)
    assert bins <= 1.01 * tokens / 2048 + 1


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """Nulls, repeats and further columns go through every stage; so does an empty table."""
    table(spark, SF, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_docs, no_docs):
        out = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = materialise(stage(spark, out, str(tmp_path)), "stage")
            assert out.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == out.select("doc_id").distinct().count()
        assert out.filter(F.col("doc_id") == 1).count() <= 1
