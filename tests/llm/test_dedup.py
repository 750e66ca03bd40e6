import re

import duckdb
import numpy as np
import xxhash

from metrilith.llm import golay_simhash as g
from metrilith.llm import queries, span_dedup


def brute_fingerprint(text, k=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fp, most=4):
    fp = np.asarray(fp, np.uint64)
    label = np.arange(len(fp))
    for k in range(len(fp)):
        near = np.bitwise_count(fp ^ fp[k]) <= most
        label[np.isin(label, label[near])] = label[near].min()
    low = {}
    for i, c in zip(ids, label, strict=True):
        low[c] = min(low.get(c, i), i)
    return [low[c] for c in label]


def test_xxh64_slices():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000, dtype=np.uint8).tobytes()
    start = rng.integers(0, 2800, 500)
    size = np.minimum(rng.integers(0, 170, 500), 3000 - start)
    assert [int(x) for x in g.xxh64(data, start, size)] == [xxhash.xxh64_intdigest(data[a : a + n], 42) for a, n in zip(start, size, strict=True)]


def test_keys_meet_at_four_bits():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    other = fp.copy()
    for i in range(len(fp)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    sets = []
    for x in (fp, other):
        own = [set() for _ in x]
        for w, k in zip(*g.fuzzy_keys(x), strict=True):
            own[w].add(int(k))
        sets.append(own)
    assert all(a & b for a, b in zip(*sets, strict=True))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by 1").fetchall()
    got = {r.doc_id: r for r in queries.op4_simhash_near_dedup(spark, sf).collect()}
    fp = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fp)
    assert [(got[i].fingerprint, got[i].component_id) for i, _ in rows] == [(f"{f:016x}", c) for f, c in zip(fp, want, strict=True)]


def test_odd_texts(spark, odd_docs, no_docs):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in g.near_duplicates(odd_docs).collect()]
    assert len(got) == odd_docs.count() and g.near_duplicates(no_docs).count() == 0
    zero = {(i, c) for i, f, c in got if f == "0" * 16}
    assert zero == {(2, 2), (3, 2), (4, 2)}
    assert {c for i, _, c in got if i in (5, None)} == {5}
    assert len({c for i, _, c in g.similar_groups(odd_docs).withColumn("f", g.F.lit(0)).select("doc_id", "f", "component_id").collect() if i == 1}) == 1
    assert g.similar_groups(no_docs).count() == 0


def chain(n, seed=3):
    """n distinct fingerprints, each a few bits from one before it, and n far ones."""
    rng = np.random.default_rng(seed)
    out = [int(rng.integers(0, 1 << 63))]
    while len(out) < n:
        x = out[rng.integers(max(0, len(out) - 5), len(out))]
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        if x not in out:
            out.append(x)
    return np.asarray([*out, *rng.integers(0, 1 << 63, n)], np.uint64)


def test_large_groups_are_joined_whole(spark):
    """Also where a group is dealt out again in blocks."""
    fp = np.unique(np.concatenate([chain(300), np.uint64(0) ^ np.asarray([1 << k for k in range(60)], np.uint64)]))
    df = spark.createDataFrame([(int(x), 0) for x in fp.view(np.int64)], "fp bigint, tab int")
    from metrilith.operators.components import connected_components

    want = brute_components(fp.view(np.int64).tolist(), fp)
    want = {int(f): c for f, c in zip(fp.view(np.int64), want, strict=True)}
    for block in (g.BLOCK, 20):
        comps = {r.node: r.component for r in connected_components(g.link_fingerprints(df, block=block)).collect()}
        assert {f: comps.get(f, f) for f in want} == want


def test_similar_groups(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(40):
        text = [words[i] for i in rng.integers(0, 5000, 200)]
        rows.append((10 * k, " ".join(text)))
        near = list(text)
        near[100] = "changed"
        rows.append((10 * k + 1, " ".join(near)))
        rows.append((10 * k + 2, " ".join(text).upper()))
        rows.append((10 * k + 3, " ".join(text[:100] + [words[i] for i in rng.integers(0, 5000, 100)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in g.similar_groups(df).collect()}
    assert got == {i: i if i % 10 == 3 else i // 10 * 10 for i, _ in rows}


def brute_similar(rows, similarity=0.8, k=5):
    """Components by comparing every pair of whole shingle sets."""
    own = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (t.lower().split() for _, t in rows)]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and len(own[a] & own[b]) >= similarity * len(own[a] | own[b]):
                x, y = label[a], label[b]
                label = [x if c == y else c for c in label]
    low = {}
    for (i, _), c in zip(rows, label, strict=True):
        low[c] = min(low.get(c, i), i)
    return {i: low[c] for (i, _), c in zip(rows, label, strict=True)}


def test_similar_groups_find_contiguous_differences(spark):
    """Appended, cut-off and replaced stretches at similarities from 0.80 to 0.90."""
    rng = np.random.default_rng(5)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    rows = []
    for k in range(60):
        text, a = draw(400), int(rng.integers(50, 250))
        copy = [text + draw(int(rng.integers(48, 96))), text[: int(rng.integers(328, 358))], text[:a] + (new := draw(int(rng.integers(20, 38)))) + text[a + len(new) :]][k % 3]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
    got = {r.doc_id: r.component_id for r in g.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows} == brute_similar(rows)


def test_rejected_links_hide_no_pair(spark):
    """Families of a template around 0.8: what a text shares with its family's first one says nothing about the others."""
    rng = np.random.default_rng(6)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    rows = []
    for size in (160, *[12] * 20):
        base = draw(120)
        for _ in range(size):
            text = list(base)
            for _ in range(int(rng.integers(1, 6))):
                a = int(rng.integers(0, 4)) * 30 + int(rng.integers(0, 10))
                text[a : a + 6] = draw(6)
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_similar(rows)
    for block in (g.BLOCK, 10):
        assert {r.doc_id: r.component_id for r in g.similar_groups(df, block=block).collect()} == want


def brute_repeats(rows, words):
    """Sentences of each document that a repeated run covers, by hash-free comparison."""
    own = {i: [t[a:b].lower().split() for a, b in span_dedup.sentences(t or "")] for i, t in rows}
    seen = {}
    for i in sorted(own):
        s = own[i]
        spans = {(k, k) for k in range(len(s)) if len(s[k]) >= 2 * words}
        enough = lambda a, b: b > a and sum(map(len, s[a : b + 1])) >= words
        for k in range(len(s)):
            # the shortest runs from a sentence on and back from one
            spans |= {(k, b) for b in [next((b for b in range(k, len(s)) if enough(k, b)), None)] if b is not None}
            spans |= {(a, k) for a in [next((a for a in range(k, -1, -1) if enough(a, k)), None)] if a is not None}
        for a, b in spans:
            seen.setdefault(tuple(sum(s[a : b + 1], [])), set()).add((i, a, b))
    gone = {i: set() for i in own}
    for places in seen.values():
        for i, a, b in sorted(places)[1:]:
            gone[i] |= set(range(a, b + 1))
    return gone


def test_repeats_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    want = brute_repeats(rows, span_dedup.WORDS)
    got = {r.doc_id: r for r in queries.op3_substring_dedup(spark, sf).collect()}
    assert sum(map(len, want.values())) > 100
    for i, text in rows:
        assert got[i].n_removed == len(want[i])
        if not want[i]:
            assert got[i].text == text
        else:
            left = [text[a:b] for k, (a, b) in enumerate(span_dedup.sentences(text)) if k not in want[i]]
            assert [got[i].text[a:b] for a, b in span_dedup.sentences(got[i].text)] == left


def test_repeats_of_odd_texts(spark, odd_docs, no_docs):
    got = span_dedup.drop_repeats(odd_docs).collect()
    assert len(got) == odd_docs.count() and span_dedup.drop_repeats(no_docs).count() == 0
    assert all(r.text == "" for r in got if r.doc_id in (2, 3))


def test_a_common_passage_is_dealt_out(spark, monkeypatch):
    """A passage in a third of all documents is found whole when its rows are spread over parts."""
    from metrilith.operators import tables

    monkeypatch.setattr(tables, "SHARE", 8)
    passage = "This passage stands in very many of the documents here. It goes on for more than a few words. And then it ends with these last words, after which the own text follows."
    rows = [(k, f"Document {k} begins with words of its own. {passage if k % 3 == 0 else ''} It ends with words {k} {k * 7} of its own.") for k in range(6000)]
    got = {r.doc_id: r for r in span_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0].n_removed == 0 and got[0].text == rows[0][1]
    assert all(got[k].n_removed == 3 and got[k].first_docs == [0] and "passage" not in got[k].text for k in range(3, 6000, 3))
    assert all(got[k].text == t for k, t in rows if k % 3)


def test_halves_of_a_hash_that_agree_by_chance(spark, monkeypatch):
    """Runs that share a key but not the whole hash leave each other alone."""
    whole = span_dedup.xxhash.xxh3_128_intdigest
    monkeypatch.setattr(span_dedup.xxhash, "xxh3_128_intdigest", lambda x: whole(x) >> 64 << 64)
    texts = ["one two three four five six seven. eight nine ten eleven twelve", "a b c d e f g. h i j k l"]
    assert [x[0] for t in texts for x in span_dedup.runs(t, 10)] and len({x[0] for t in texts for x in span_dedup.runs(t, 10)}) == 1
    rows = spark.createDataFrame([(1, *span_dedup.runs(texts[0], 10)[0][:2]), (2, *span_dedup.runs(texts[1], 10)[0][:2])], "doc_id bigint, h bigint, g bigint")
    assert rows.groupBy("h", "g").count().filter("count > 1").count() == 0 and rows.select("h").distinct().count() == 1


def test_keys_with_the_same_members_count_once(spark):
    """Two long texts share many shingles; each pair is proposed once for a set of members, not once for each key."""
    rows = [(k, node, 60, k) for k in range(50) for node in (1, 2, 3)] + [(k, node, 60, k) for k in range(50, 55) for node in (1, 4)]
    comps = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "node bigint, component bigint")
    entries = spark.createDataFrame(rows, "key bigint, node bigint, size int, pos int")
    at, keys = g._unequal(entries, comps, 0, g.Scratch(spark, "test"))
    assert sorted((r.n, r.top, r.key) for r in keys.collect()) == [(2, 1, 50), (3, 2, 0)]
    nodes = spark.createDataFrame([(n, [0] * g.BRIEF) for n in (1, 2, 3, 4)], "node bigint, brief array<bigint>")
    got = sorted(tuple(sorted(r)) for r in g._all_pairs(at, keys, nodes, 0.8, 8).collect())
    assert got == [(1, 3), (1, 4), (2, 3)]


def test_long_texts_that_share_many_keys_make_few_pairs(spark):
    """A pair is made at the first key that both share; long texts that share only a few keys are told apart by wide sketches."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 62, 3000, dtype=np.int64).view(np.uint64)
    own = {n: np.unique(np.concatenate([common[:share], rng.integers(0, 1 << 62, 3000 - share, dtype=np.int64).view(np.uint64)])) for n, share in [(1, 2900), (2, 2900), (3, 20), (4, 20)]}
    # every key has members of its own besides, so that none stands for another
    rows = [(k, n, 3000, 10 + k) for k in range(20) for n in (1, 2, 3, 4)] + [(k, n, 3000, 10 + k) for k in range(20, 300) for n in (1, 2)] + [(k, 1000 + k, 3000, 2999) for k in range(300)]
    others = range(1000, 1300)
    comps = spark.createDataFrame([(n, n) for n in (*own, *others)], "node bigint, component bigint")
    at, keys = g._unequal(spark.createDataFrame(rows, "key bigint, node bigint, size int, pos int"), comps, 0, g.Scratch(spark, "test"))
    assert keys.count() == 300
    fold = lambda x, n: np.bitwise_xor.reduce(x.reshape(-1, min(n, len(x))), axis=0)
    sketch = lambda x: np.concatenate([fold(g._sketch(x), 8), fold(g._sketch(x), 64)]).tolist()
    nodes = [(n, sketch(x)) for n, x in own.items()] + [(n, sketch(common[:1])) for n in others]
    got = sorted(tuple(sorted(r)) for r in g._all_pairs(at, keys, spark.createDataFrame(nodes, "node bigint, brief array<bigint>"), 0.8, 8).collect())
    assert got == [(1, 2)]
