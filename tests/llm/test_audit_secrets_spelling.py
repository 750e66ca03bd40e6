"""Filter orders, secret formats and spelling variants against plain loops."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from metrilith.llm import filter_audit, grammar, spelling

# --- filters -----------------------------------------------------------------------------


def brute_audit(rows, labels):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for (i, t, _), w in zip(rows, words, strict=True):
        t = t or ""
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]]
        fails.append({f for f, b in zip("ABCDE", bad, strict=True) if b})
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = set()
    parts = {p or "" for *_, p in rows}
    for part in parts:
        mine = [(f, i) for f, (i, _, p) in zip(fails, rows, strict=True) if (p or "") == part]
        shapley = Counter()
        found = []
        for order in itertools.permutations("ABCDE"):
            alive = mine
            for k, f in enumerate(order):
                gone = [x for x in alive if f in x[0]]
                alive = [x for x in alive if f not in x[0]]
                shapley[f] += len(gone)
                found.append((f, (part, "".join(order), k + 1, len(alive), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone))))
        out |= {(*x, shapley[f]) for f, x in found}
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, lang string, good int, same string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = filter_audit.edges(filter_audit.judged(docs, marks), list("ABCDE"), ["good", "toxic"])
    report = filter_audit.report(found, list("ABCDE"), ["good", "toxic"])
    return [tuple(r) for r in report.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "removed_good", "removed_toxic", "shapley").collect()]


def test_filter_orders_against_plain_loops(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice(["one", "Two", "THREE", "x#y", "four"]) for _ in range(rng.choice([0, 5, 250]))) for _ in range(8)]
    pool += [" ".join(f"word{k}" for k in range(300)), "Ünïcödé " * 250, "A" * 5000, None, "", "\t \n"]
    rows = [(k if rng.random() < 0.9 else None, rng.choice(pool), rng.choice(["en", "de", None, ""])) for k in range(120)]
    rows += rows[:4]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1)]
    got = audited(spark, rows, labels)
    want = brute_audit(rows, labels)
    assert len(got) == len(set(got)) == len(want) and set(got) == want


def test_no_documents_and_other_filters(spark):
    rows = spark.createDataFrame([("p", True, None), ("p", False, True), ("p", True, True)], "part string, f boolean, g boolean")
    got = {(r.state, r.filter): (r.kept, r.removed) for r in filter_audit.edges(rows, ["f", "g"], []).collect()}
    assert got == {(0, "f"): (1, 2), (0, "g"): (1, 2), (1, "g"): (0, 1), (2, "f"): (0, 1)}
    assert filter_audit.report(filter_audit.edges(rows.limit(0), ["f", "g"], []), ["f", "g"], []).count() == 0


# --- secrets -----------------------------------------------------------------------------


def brute_base(text):
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans_against_plain_patterns():
    rng = random.Random(9)
    bits = ["password", "TOKEN", "Api_Key", "apikey", "paſſword", "toKen", ":", "=", " ", '"', "'", "abc", "deadbeef" * 3, "AKIA", "ABCDEF0123456789", "é", ".", "secret=abcdef", "\n", "token: token: abcdefgh"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert [x[:3] for x in grammar.base_spans(text)] == brute_base(text), text


def credentials(rng, n):
    return ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(n)]


def plain_bits(automaton, value):
    state, total = 0, 0.0
    for a in grammar.classes(value):
        total, state = total + automaton.chance[state][a], automaton.follow[state][a]
    return total + automaton.end[state]


def test_formats_are_learnt_and_others_left_alone(spark, odd_docs, no_docs):
    rng = random.Random(1)
    words = ["Donaudampfschifffahrt", "verantwortlichkeiten", "internationalisation", "2024-01-01-12-30-00", "a/path/to/some/file/of/it"]
    plain = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(200)]
    known = [(1000 + k, f"x token = {c} y") for k, c in enumerate(credentials(rng, 300))]
    # capitals keep a run from being a match of the fixed patterns
    hidden = [(2000 + k, f"see {c.upper()[:3].replace('0', '1')}{c} here") for k, c in enumerate(credentials(rng, 50))]
    docs = spark.createDataFrame(plain + known, "doc_id bigint, text string").withColumn("spans", F.lit("own"))
    automata = grammar.learn(docs)
    assert {"assign", "hex"} <= set(automata) and len(automata["hex"].end) < 40
    value = credentials(rng, 1)[0]
    assert abs(automata["hex"].bits(grammar.classes(value)) - plain_bits(automata["hex"], value)) < 1e-9
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in grammar.detect(docs, automata).collect()}
    assert not any(spans[k] for k, _ in plain)
    assert all([x[0] for x in spans[k]] == ["assign", "hex"] for k, _ in known)
    lower = spark.createDataFrame([(k, t.replace("here", "")) for k, t in hidden], "doc_id bigint, text string")
    found = {r.doc_id: [s.kind for s in r.spans] for r in grammar.detect(lower, automata).collect()}
    assert sum(bool(x) for x in found.values()) >= 45
    # odd texts keep their rows; nothing learnt means nothing added
    assert grammar.detect(odd_docs, automata).count() == odd_docs.count()
    assert grammar.detect(no_docs, grammar.learn(no_docs)).count() == 0
    assert grammar.detect(odd_docs, grammar.learn(no_docs)).filter(F.size("spans") > 0).isEmpty()


def test_prefix_counts(spark):
    rows = [("k", "00f", 2), ("k", "0", 1), ("k", "00f", 1), ("j", "", 5)]
    got = {(r.kind, r.prefix): (r.n, r.ended, r.next) for r in grammar.prefixes(spark.createDataFrame(rows, "kind string, value string, n bigint")).collect()}
    assert got == {("k", ""): (4, 0, {"0": 4}), ("k", "0"): (4, 1, {"0": 3}), ("k", "00"): (3, 0, {"f": 3}), ("k", "00f"): (3, 3, {}), ("j", ""): (5, 5, {})}


def test_trees_reach_the_ends_of_long_values(spark):
    """All prefixes with a fair share, of any length, by counting them one by one."""
    draw = random.Random(4)
    some = lambda n: "".join(draw.choice("0fZ") for _ in range(n))
    one, two = some(90), some(32)
    ends = [some(40) for _ in range(3)]
    values = [("k", some(draw.randrange(60))) for _ in range(400)] + [("k", v) for v in [one, one[:70], one[:64], one[:32]] for _ in range(30)] + [("k", two + e) for e in ends for _ in range(12)]
    values += [("k", two + ends[0][:10]), ("k", two)] * 9 + [("j", "0" * 40 + "F" * 20)] * 50 + [("j", "")] * 4
    want = {}
    for kind in "kj":
        n, ended, follow = Counter(), Counter(), defaultdict(Counter)
        mine = [v for k, v in values if k == kind]
        for v in mine:
            ended[v] += 1
            for i in range(len(v) + 1):
                n[v[:i]] += 1
                follow[v[:i]].update(v[i : i + 1])
        want[kind] = {p: (m, ended[p], dict(follow[p])) for p, m in n.items() if m >= max(grammar.FEWEST, len(mine) / grammar.SHARE)}
    df = spark.createDataFrame([(k, v, 1) for k, v in values], "kind string, value string, n bigint")
    assert grammar.trees(df) == want and max(map(len, want["k"])) == 90
    assert grammar.trees(df.limit(0)) == {}
    a = grammar.infer(df)["j"]
    assert a.bits("0" * 40 + "F" * 20) > a.bits("0" * 60) + 20


def test_automaton_merges_what_agrees():
    # any number of f after 0: one state before, one state that goes on, however deep the tree is
    tree, n = {"": (4096, 0, {"0": 4096})}, 4096
    for k in range(9):
        tree["0" + "f" * k] = (n, n // 2, {"f": n // 2})
        n //= 2
    a = grammar.Automaton({p: x for p, x in tree.items() if x[0] >= 16})
    assert len(a.end) == 2
    assert a.bits("0fff") > a.bits("ffff")


# --- spelling ----------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, times=5):
    out = set()
    form = {}
    for w, n in words.items():
        near = sorted((-words[v], v) for v in words if one_edit(w, v))
        if near and -near[0][0] >= times * n:
            form[w] = (near[0][1], -near[0][0])
        out.add((w, n, len(near), *form.get(w, (None, None))))
    rooted = set()
    for w, n, k, f, fn in out:
        root = w
        while root in form:
            root = form[root][0]
        rooted.add((w, n, k, f, fn, root))
    return rooted


@pytest.mark.parametrize("crowd", [2, 32])
def test_variants_against_all_pairs(spark, crowd):
    rng = random.Random(crowd)
    letters = "abcÀéÿ"
    words = {}
    while len(words) < 500:
        w = "".join(rng.choice(letters[:3] if rng.random() < 0.5 else letters) for _ in range(rng.randrange(6, 10)))
        words[w] = rng.choice([5, 6, 30, 200, 5000])
    words |= {"banana" * 3: 9, "banana" * 3 + "b": 50, "anana" + "banana" * 2: 5, "aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = [tuple(r) for r in spelling.variants(df, crowd=crowd).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(words) and set(got) == brute_variants(words)


def test_words_of_texts(spark, odd_docs, no_docs):
    text = "Ünïcödé ÀÉÈ×÷ naïvetés Abcdefg abcdefg's ABCDEFG-abcdefg 測試 " + "x" * 30_000
    rows = [(k, text) for k in range(400)] + [(None, text), (1, text), (2, None), (3, "")]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            want[run] += 1
    got = {r.word: r.n for r in spelling.vocabulary(spelling.misspelt(spelling.runs(spark.createDataFrame(rows, "doc_id bigint, text string")))).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert spelling.variants(spelling.vocabulary(spelling.misspelt(spelling.runs(no_docs)))).count() == 0
    assert spelling.vocabulary(spelling.runs(odd_docs), occurrences=1).count() > 0


def test_digest_of_secrets(spark, small):
    from metrilith.llm import queries

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op12_secret_scan(spark, small).collect():
        base = brute_base(docs[r.doc_id])
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert all(x in r.spans.split(",") for x in text.split(",") if x)
