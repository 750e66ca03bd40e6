import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from metrilith.llm import bpe, packing, queries, token_store

PATHS = {"drop_space": queries.vocabulary("word_bpe_49k.json"), "lead_space": queries.vocabulary("byte_bpe_50k.json")}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("cut", PATHS)
def test_pieces_encode_like_whole_texts(cut):
    rng = random.Random(7)
    bits = ["a", "The", "word.", "it's", "we'll", "42", "3.14", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "é", "é", "́", "測試", "Σ", "ΑΣ", "İ", "😀", "<|endoftext|>", "<|startoftext|>", "%%%", "|", "_", "\x00", "\x01"]
    texts = ["", " ", "\n", " a", "a ", "a\nb", "\na", "a\n"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    whole = Tokenizer.from_file(PATHS[cut]).encode_batch(texts, add_special_tokens=False)
    enc = bpe.PieceEncoder(PATHS[cut], cut)
    for _ in range(2):
        for text, got, want in zip(texts, enc.encode(texts), whole, strict=True):
            assert np.frombuffer(got, enc.dtype).tolist() == want.ids, repr(text)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (1, 10**12), (3, 2**62), (5000, 5000), (5, 3), (300, 200), (1000, 10**9), (700, 700)):
        values = np.sort(rng.integers(0, top + 1, n))
        ef = token_store.EliasFano.encode(values)
        again = token_store.EliasFano(**ef.row())
        assert again.take(np.arange(n)).tolist() == values.tolist() and [again[i] for i in range(n)] == values.tolist()
        some = rng.integers(0, n, 2 * n)
        assert again.take(some).tolist() == values[some].tolist()
        assert 8 * (len(ef.low) + len(ef.high)) <= n * (3 + np.log2(max(top, n) / n)) + 24
    assert token_store.EliasFano.encode([]).take(np.zeros(0)).tolist() == []


def test_store_against_plain_encoding(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by 1").fetchall()
    t = Tokenizer.from_file(PATHS["drop_space"])
    start, want = 0, []
    for (i, text), e in zip(rows, t.encode_batch([r[1] or "" for r in rows], add_special_tokens=False), strict=True):
        ids = [*e.ids, 1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, queries.op6_token_ids(spark, sf).collect())) == want


def test_store_of_odd_texts(spark, odd_docs, no_docs, monkeypatch):
    for docs in (odd_docs, no_docs):
        path = token_store.new_store(spark)
        token_store.write_store(docs, path, PATHS["drop_space"], "drop_space", 1)
        got = token_store.read_store(spark, path).orderBy("start").collect()
        assert len(got) == docs.count()
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
        ids = [r.doc_id for r in got]
        assert ids == sorted(ids, key=lambda x: (x is not None, x))


def test_bound_and_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        where, offset, room = packing.best_fit(lengths, 100)
        fill = np.bincount(where, lengths, len(room))
        assert (fill + room == 100).all() and (room >= 0).all()
        for b in range(len(room)):
            own = np.flatnonzero(where == b)
            own = own[np.argsort(offset[own])]
            assert (offset[own] == np.cumsum(lengths[own]) - lengths[own]).all()
        bound = packing.lower_bound(lengths, 100)
        assert -(-int(lengths.sum()) // 100) <= bound <= len(room)
    assert packing.lower_bound(np.full(10, 51), 100) == 10 and packing.lower_bound(np.full(9, 34), 100) == 5


def check_packed(rows, docs, capacity=2048):
    t = Tokenizer.from_file(PATHS["lead_space"])
    want = defaultdict(int)
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        head = len(ids) % capacity or min(capacity, len(ids))
        for k, a in enumerate([0, *range(head, len(ids), capacity)]):
            b = head if k == 0 else a + capacity
            want[i, k, a, b - a, crc(ids[a:b])] += 1
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(k[3] * n for k, n in want.items())


def test_packing_against_plain_encoding(spark):
    sf = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    bins, tokens = check_packed(queries.op10_best_fit_packing(spark, sf).collect(), docs)
    assert bins <= 1.01 * tokens / 2048 + 1


def test_packing_of_odd_texts(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 3)
    rows = packing.pack_documents(odd_docs, PATHS["lead_space"], "lead_space", 0).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in odd_docs.collect()])
    # a certified group meets its bound, no group lies below it
    assert all(r.bins >= r.bound for r in rows)
    assert packing.pack_documents(no_docs, PATHS["lead_space"], "lead_space", 0).count() == 0


def test_groups_with_a_gap_exchange_pieces(spark, monkeypatch):
    """Pieces that a bad deal left unpaired meet in a later round, down to the bound of all; copies without ids are dealt out too."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 8)
    rows = [(None, 0, 0, n, 0) for n in [60] * 40 + [40] * 40] + [(k, 0, 0, 100, 0) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    count = lambda rounds: packing.pack(df, 100, rounds).select("sequence_id").distinct().count()
    first, last = count(0), count(6)
    assert packing.lower_bound(np.asarray([r[3] for r in rows]), 100) == 43
    assert 43 <= last < first


def test_sequence_numbers_of_many_groups_dont_meet():
    local = np.arange(1 << 14)
    seen = {}
    for group in (0, 1, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, 1 << 23, (1 << 40) - 1, 1 << 40, (1 << 46) - 1):
        for round_no in range(8):
            ids = packing.sequence_ids(group, round_no, local)
            assert (np.diff(ids) == 1).all() and ids[0] >= 0
            seen[int(ids[0])] = (group, round_no)
    starts = sorted(seen)
    assert len(starts) == 72 and all(b - a >= 1 << 14 for a, b in zip(starts, starts[1:], strict=False))
    with pytest.raises(OverflowError):
        packing.sequence_ids(0, 0, np.array([1 << 14]))


def test_groups_of_one_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 1)
    pieces = spark.createDataFrame([(k, 0, 0, 100 + k, 0) for k in range(60)] + [(99, 0, 0, 2048, 0)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    got = packing.pack(pieces, rounds=2).collect()
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert len(got) == 61 and max(ends.values()) <= 2048


def test_led_pieces_of_odd_texts_and_few_encodings():
    enc = bpe.PieceEncoder(PATHS["lead_space"], "lead_space")
    enc.most = 200
    rng = random.Random(1)
    letters = ["a", "Bc", "don't", "'s", "12", "...", "!!", "  ", " ", " ", " ", "\n", "\t", "é", "×", "_", "<|endoftext|>", "<|", "|>", "\x1c", "\xa0", "　", "́", "½", "$$$", "\r", "-", "#'"]
    for _ in range(40):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(50)] + ["", "\t", "\tx", "a \tb", "\n", "a\n\tb", " ", "\tx \tx"]
        want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want

    class Counted:
        def __init__(self, inner):
            self.inner, self.n = inner, 0

        def encode_batch_fast(self, texts, **kw):
            self.n += len(texts)
            return self.inner.encode_batch_fast(texts, **kw)

    enc = bpe.PieceEncoder(PATHS["lead_space"], "lead_space")
    enc.tokenizer = Counted(enc.tokenizer)
    words = [f"word{k}" for k in range(300)]
    enc.encode([" ".join(w + marks for w in words) for marks in ("", ",", ".", "***", "###")])
    assert enc.tokenizer.n <= 310  # 1,500 where marks make pieces of their own


def test_words_that_differ_in_case_or_marks_are_encoded_once():
    """The ids of such texts are those of the whole text, and the tokenizer itself sees each word once."""
    enc = bpe.PieceEncoder(queries.vocabulary("word_bpe_49k.json"), "drop_space")
    texts = ["Word word, WORD. (word) WORD'S word's; \u00c9t\u00e9 \u00c9T\u00c9! \u00e9t\u00e9?", "H\u0331 h\u0331. K\u0331, \u0130x ", "a<|endoftext|> A<|ENDOFTEXT|>b, <|startoftext|>", "", "12, 12. x-1, X-1;"]
    want = [enc.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want
    enc.known.clear()
    seen: list[str] = []
    plain = enc._plain
    enc._plain = lambda x: seen.extend(x) or plain(x)
    got = enc.encode(["Word word, WORD. \u00c9t\u00e9 \u00c9T\u00c9! \u00e9t\u00e9?"])
    assert np.frombuffer(got[0], enc.dtype).tolist() == enc.tokenizer.encode("word word, word. \u00e9t\u00e9 \u00e9t\u00e9! \u00e9t\u00e9?", add_special_tokens=False).ids
    assert len([x for x in seen if x[:1].isalpha()]) == 2
