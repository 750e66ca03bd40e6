"""SimHash fingerprints, linked at a few differing bits by fuzzy hashing with a Golay code.

The binary Golay code of length 24 lies so densely that every word of even weight is either
within 2 bits of one codeword or at 4 bits from exactly six. Two even words that differ
in two bits always share one of these codewords. A part of at most 23 fingerprint bits, made
even by a parity bit, therefore gives one or six codeword indices, and parts that differ in
up to two bits share an index.

A fingerprint is three parts, A and B of 23 bits and C of 18. With at most 4 differing bits
in all, either A and B both differ in at most two (they share a pair of indices), or one
of them differs in three or more and the other two parts in at most one (one of the two is
equal, the other shares an index). These pairs are the keys; fingerprints that meet in a
key are compared, and the links of a key's group are kept as a spanning forest, so that a
large group of near copies gives as many rows as members, not as pairs.
"""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrilith.llm.common import id_and_text, slices, utf8
from metrilith.operators.components import connected_components
from metrilith.operators.tables import Scratch, join_one

SEED = 42
SHINGLE = 4
#: Differing bits that still link; the keys hold for up to this many.
MOST_BITS = 4
#: Shingles that are hashed at once.
PORTION = 1 << 17
#: Groups above this are dealt out again in blocks of this many members.
BLOCK = 1 << 15
#: Groups up to this are compared by shifts over the whole batch.
SMALL = 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of `data` at once."""
    padded = data + b"\0" * 8
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    four = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    one = np.frombuffer(padded, np.uint8)
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), s + P5, np.uint64)
        at = starts.astype(np.int64).copy()
        left = lengths.astype(np.int64).copy()
        if len(long := np.flatnonzero(left >= 32)):
            v = [np.full(len(long), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            live = np.arange(len(long))
            while len(live):
                where = at[long[live]]
                for k in range(4):
                    v[k][live] = _round(v[k][live], eight[where + 8 * k])
                at[long[live]] += 32
                left[long[live]] -= 32
                live = live[left[long[live]] >= 32]
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _round(np.zeros_like(x), x)) * P1 + P4
            h[long] = acc
        h += lengths.astype(np.uint64)
        for _ in range(3):
            live = np.flatnonzero(left >= 8)
            h[live] = _rotl(h[live] ^ _round(np.zeros(len(live), np.uint64), eight[at[live]]), 27) * P1 + P4
            at[live] += 8
            left[live] -= 8
        live = np.flatnonzero(left >= 4)
        h[live] = _rotl(h[live] ^ (four[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
        at[live] += 4
        left[live] -= 4
        for _ in range(3):
            live = np.flatnonzero(left > 0)
            h[live] = _rotl(h[live] ^ (one[at[live]].astype(np.uint64) * P5), 11) * P1
            at[live] += 1
            left[live] -= 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def _words(texts: list[bytes]) -> list[list[bytes]]:
    return [x.translate(_LOWER).split() for x in texts]


class Shingles:
    """The shingles of many texts, hashed in portions.

    full: the texts that have words; edge: where each one's shingles begin and end.
    """

    def __init__(self, words: list[list[bytes]], shingle: int):
        self.n = np.asarray([len(w) for w in words], np.int64)
        self.full = np.flatnonzero(self.n)
        self.n = self.n[self.full]
        self.shingle = shingle
        self.data = b" ".join(itertools.chain.from_iterable(words))
        self.ends = np.append(np.flatnonzero(np.frombuffer(self.data, np.uint8) == 32), len(self.data))
        self.begins = np.concatenate([[0], self.ends[:-1] + 1])
        self.first = np.cumsum(self.n) - self.n
        self.count = np.maximum(self.n - shingle + 1, 1)
        self.edge = np.concatenate([[0], np.cumsum(self.count)])

    def portions(self):
        """(first text, last text + 1, where each one's begin, hashes) of runs of shingles."""
        edge = self.edge
        for a in range(0, int(edge[-1]), PORTION):
            b = min(a + PORTION, int(edge[-1]))
            lo, hi = np.searchsorted(edge, a, "right") - 1, np.searchsorted(edge, b, "left")
            own = np.repeat(np.arange(lo, hi), np.minimum(edge[lo + 1 : hi + 1], b) - np.maximum(edge[lo:hi], a))
            w = self.first[own] + np.arange(a, b) - edge[own]
            start = self.begins[w]
            length = self.ends[w + np.minimum(self.shingle, self.n[own]) - 1] - start
            yield lo, hi, np.maximum(edge[lo:hi], a) - a, xxh64(self.data, start, length)


def fingerprints(texts: list[bytes], shingle: int = SHINGLE, tables: int = 1) -> np.ndarray:
    """SimHash of UTF-8 texts: bit k is set if it is in over half the shingles' hashes.

    With several tables a row for each: the second and later ones mix the same hashes anew.
    """
    words = _words(texts)
    out = np.zeros((tables, len(texts)), np.uint64)
    if any(words):
        s = Shingles(words, shingle)
        sums = np.zeros((tables, len(s.full), 64), np.int64)
        for lo, hi, at, h in s.portions():
            for t in range(tables):
                if t:
                    with np.errstate(over="ignore"):
                        h = (h ^ (h >> np.uint64(31))) * P2 + P5
                        h ^= h >> np.uint64(29)
                bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                sums[t, lo:hi] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        set_bits = (2 * sums > s.count[:, None]).astype(np.uint8)
        out[:, s.full] = np.packbits(set_bits, axis=2, bitorder="little").view("<u8")[:, :, 0]
    return out if tables > 1 else out[0]


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits, and for each syndrome the error patterns and their number."""
    # Fixed value: a generator polynomial of the binary Golay code of length 23.
    generator = 0b110001110101
    upper = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        upper = np.where(upper >> bit & 1, upper ^ (generator << (bit - 11)), upper)
    patterns = [0]
    for weight in (2, 4):
        patterns += [sum(1 << k for k in x) for x in itertools.combinations(range(24), weight)]
    low = np.asarray(patterns, np.int64) & ((1 << 23) - 1)
    syndrome = upper[low >> 11] ^ (low & 0x7FF)
    order = np.argsort(syndrome, kind="stable")
    number = np.bincount(syndrome, minlength=1 << 11)
    table = np.zeros((1 << 11, 6), np.int64)
    place = np.arange(len(order)) - (np.cumsum(number) - number)[syndrome[order]]
    table[syndrome[order], place] = low[order]
    return upper, table, number


def golay_indices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of up to 23 bits: (n, 6) indices of the nearby codewords, and how many count."""
    upper, table, number = _code()
    x = x.astype(np.int64)
    s = upper[x >> 11] ^ (x & 0x7FF)
    return (x[:, None] ^ table[s]) >> 11, number[s]


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, key) for all keys of all fingerprints."""
    a, b, c = (fp & np.uint64(0x7FFFFF)).astype(np.int64), (fp >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64), (fp >> np.uint64(46)).astype(np.int64)
    (ia, na), (ib, nb), (ic, nc) = golay_indices(a), golay_indices(b), golay_indices(c)
    who, keys = [], []

    def add(family: int, key: np.ndarray, valid: np.ndarray):
        key = np.broadcast_to(key, valid.shape)
        w, *_ = np.nonzero(valid)
        who.append(w)
        keys.append(key[valid] | (family << 40))

    six = np.arange(6)
    va, vb, vc = (six < n[:, None] for n in (na, nb, nc))
    add(1, ia[:, :, None] << 12 | ib[:, None, :], va[:, :, None] & vb[:, None, :])
    add(2, c[:, None] << 12 | ib, vb)
    add(3, b[:, None] << 12 | ic, vc)
    add(4, c[:, None] << 12 | ia, va)
    add(5, a[:, None] << 12 | ic, vc)
    return np.concatenate(who), np.concatenate(keys)


def _forest(fp: np.ndarray, most: int, split: int = 0) -> list[tuple[int, int]]:
    """Links that join all of `fp` which any chain of links joins; with `split`, members before and from it are compared with one another only."""
    label = np.arange(len(fp))
    parts = len(fp)
    out: list[tuple[int, int]] = []
    for k in range(split or len(fp) - 1):
        if parts == 1:
            break
        a = max(split, k + 1)
        near = a + np.flatnonzero(np.bitwise_count(fp[a:] ^ fp[k]) <= most)
        if not len(near):
            continue
        labels, at = np.unique(label[near], return_index=True)
        new = labels != label[k]
        if new.any():
            out += [(int(fp[k]), int(fp[near[i]])) for i in at[new]]
            parts -= int(new.sum())
            label[np.isin(label, labels[new])] = label[k]
    return out


#: The number of a fingerprint's table stands above a key's other bits.
_TABLE = 48
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("big", pa.int64()), ("tab", pa.int32())])
_EDGE_DDL = "u bigint, v bigint, big bigint, tab int"


def _edges(u=(), v=(), big=None, tab=0) -> pa.RecordBatch:
    u = np.asarray(u, np.uint64).view(np.int64)
    tab = np.broadcast_to(np.asarray(tab, np.int32), u.shape)
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.asarray(v, np.uint64).view(np.int64)), pa.array([big] * len(u), pa.int64()), pa.array(tab)], schema=_EDGE)


def _spanning(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Links of a spanning forest of the given ones, taken in ascending order."""
    u, v, tab = (batch.column(c).to_numpy() for c in ("u", "v", "tab"))
    edges = np.unique(np.stack([tab, np.minimum(u, v), np.maximum(u, v)]), axis=1).T.tolist()
    parent: dict[tuple, tuple] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    kept = []
    for t, a, b in edges:
        p, q = root((t, a)), root((t, b))
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((t, a, b))
    t, a, b = zip(*kept, strict=True)
    return _edges(np.asarray(a).view(np.uint64), np.asarray(b).view(np.uint64), tab=t)


def _fewer(batches):
    """The links of a task, cut down to a spanning forest whenever many have come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.column("big").null_count < batch.num_rows:
            yield batch
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) > 1 << 18:
            held = [_spanning(pa.Table.from_batches(held).combine_chunks().to_batches()[0])]
    if sum(x.num_rows for x in held):
        yield _spanning(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _compare(most: int, block: int):
    """Links within the groups of equal `key`; batches come sorted by (key, fp)."""

    def run(batches):
        yield from _fewer(compared(batches))

    def compared(batches):
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        skipped = None

        def groups(key, fp):
            for k in range(1, SMALL):
                same = key[k:] == key[:-k]
                if not same.any():
                    return
                hit = np.flatnonzero(same & (np.bitwise_count(fp[k:] ^ fp[:-k]) <= most))
                if len(hit):
                    yield _edges(fp[hit], fp[hit + k], tab=key[hit] >> _TABLE)
            edge = np.flatnonzero(np.diff(key, prepend=key[0] - 1, append=key[-1] + 1))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a > SMALL and (links := _forest(fp[a:b], most)):
                    yield _edges(*zip(*links, strict=True), tab=key[a] >> _TABLE)

        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                k = batch.column("key").to_numpy(zero_copy_only=False)
                f = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                if skipped is not None:
                    more = k != skipped
                    k, f = k[more], f[more]
                key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
                if not len(key):
                    continue
                whole = np.searchsorted(key, key[-1])  # the last group may go on
            else:
                whole = len(key)
            if whole:
                yield from groups(key[:whole], fp[:whole])
            key, fp = key[whole:], fp[whole:]
            if len(key) > block:
                skipped = int(key[0])
                yield _edges([0], [0], skipped)
                key, fp = key[:0], fp[:0]

    return run


def _compare_blocks(most: int):
    """Links within a block, or between two, of a group that was dealt out again."""

    def run(key, table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        block = table.column("block").to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        first, second = np.sort(fp[block == i]), np.sort(fp[block == j])
        links = _forest(first, most) if i == j else _forest(np.concatenate([first, second]), most, len(first)) if len(first) and len(second) else []
        return pa.Table.from_batches([_edges(*zip(*links, strict=True), tab=key[0].as_py() >> _TABLE) if links else _edges()])

    return run


def link_fingerprints(fps: DataFrame, most: int = MOST_BITS, block: int = BLOCK, kept: Scratch | None = None) -> DataFrame:
    """(u, v, tab) links over the distinct values of `fp` within each `tab`: two fingerprints are joined by a chain of them if a chain of steps of at most `most` bits joins them.

    `tab` (int) tells apart the fingerprints of several hash functions. Each task cuts its
    links down to a spanning forest, so there are far fewer than pairs.
    """
    if most > MOST_BITS:
        raise ValueError(f"the keys find all links of at most {MOST_BITS} bits")
    kept = kept or Scratch(fps.sparkSession, "links")

    def keys(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            tabs = batch.column("tab").to_numpy(zero_copy_only=False).astype(np.int64)
            for a in range(0, len(fps), 2000):
                fp, tab = fps[a : a + 2000], tabs[a : a + 2000]
                who, key = fuzzy_keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key | tab[who] << _TABLE), pa.array(fp[who].view(np.int64))], names=["key", "fp"])

    keyed = fps.select("fp", "tab").mapInArrow(keys, "key bigint, fp bigint")
    links = kept.write(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_compare(most, block), _EDGE_DDL), "links")
    big = links.filter("big is not null").select(F.col("big").alias("key")).distinct()
    out = links.filter("big is null").select("u", "v", "tab")
    if big.limit(1).count():
        met = kept.write(keyed.join(big, "key"), "big-groups")
        blocks = met.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        dealt = met.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        dealt = dealt.select("key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        pair = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
        out = out.union(pair.groupBy("key", "i", "j").applyInArrow(_compare_blocks(most), _EDGE_DDL).select("u", "v", "tab"))
    return out.distinct()


def simhash(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed number."""

    def run(batches):
        for batch in slices(batches):
            fp = fingerprints(utf8(batch.column("text")), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest doc_id of the texts that links reach; copies share a
    fingerprint and are one node, so they add no links. A text of fewer words than a
    shingle is one shingle; null, empty and wordless texts have fingerprint zero and are
    linked like any other. Rows with a null id take part and can't name a component; one
    of such rows alone has none. Repeated rows give a row each.
    """
    kept = Scratch(docs.sparkSession, "near-duplicates")
    prints = kept.write(simhash(docs, shingle, id_col, text_col), "fingerprints")
    nodes = kept.write(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    comps = connected_components(link_fingerprints(nodes.withColumn("tab", F.lit(0)), most, kept=kept))
    linked = kept.write(comps.join(nodes.withColumnRenamed("fp", "node"), "node"), "linked")
    least = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    named = join_one(linked, least, ["component"], "node").select(F.col("node").alias("fp"), "component_id")
    labels = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return join_one(prints, labels, ["fp"], "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For similarity on shingles of five words: words in a shingle of the fingerprints that
#: propose pairs, and the number of such fingerprints.
PROPOSING, TABLES = 2, 4
#: Counters of how often shingles occur; they decide how many pairs are compared, not which are found.
COUNTERS = 22
#: Least and most bits of a text's sketch, which tell whether an odd number of its shingles falls on each.
SKETCH, SKETCH_MOST = 1 << 10, 1 << 16
#: Words of 64 bits in a brief sketch, and most in the wide one behind it, both of which every member of a key carries.
BRIEF, WIDE = 8, 64
#: Earlier keys that every member of a key carries.
EARLIER = 16


def _sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for a text without words."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    words = _words(texts)
    if any(words):
        s = Shingles(words, shingle)
        hashes = np.concatenate([h for *_, h in s.portions()])
        for k, x, y in zip(s.full.tolist(), s.edge[:-1], s.edge[1:], strict=True):
            out[k] = np.unique(hashes[x:y])
    return out


def _sketch(own: np.ndarray) -> np.ndarray:
    """Bits of a set, at least as many as it has members: two sets differ in at least as many members as their sketches do in bits."""
    bits = min(max(SKETCH, 1 << (len(own) - 1).bit_length()), SKETCH_MOST) if len(own) else SKETCH
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of at most so many words of 64 bits."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0) if len(sketch) > words else sketch


def _differing(a: str, b: str) -> Column:
    """Bits in which two sketches differ, the longer one folded to the other's length; twice as long at most."""
    n = F.least(F.size(a), F.size(b))
    fold = lambda x: F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)


_PRINT = "doc_id bigint, node bigint, fps array<bigint>, size int, sketch array<bigint>, brief array<bigint>, slots array<int>, times array<int>"


def _printed(rows: DataFrame, tables: int, shingle: int) -> DataFrame:
    """For each row its fingerprints, the size of its shingle set and the set's sketch; for each task one row of counters (upper bits of hashes) that stand out in it."""

    def run(batches):
        n = np.zeros(1 << COUNTERS, np.int32)
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        names = [x.split()[0] for x in _PRINT.split(", ")]
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            own = _sets(texts, shingle)
            for x in own:  # distinct within a text
                slot, times = np.unique((x >> np.uint64(64 - COUNTERS)).astype(np.int32), return_counts=True)
                n[slot] += times.astype(np.int32)
            fps = fingerprints(texts, PROPOSING, tables).reshape(tables, -1).T.view(np.int64)
            none = pa.nulls(len(texts), ints)
            sketch = [_sketch(x) for x in own]
            brief = [np.concatenate([_folded(x, n) for n in (BRIEF, WIDE)]) for x in sketch]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(list(fps), longs), pa.array([len(x) for x in own], pa.int32()), pa.array(sketch, longs), pa.array(brief, longs), none, none], names=names)
        mean = n.mean()
        out = np.flatnonzero(n > mean + 4 * np.sqrt(mean) + 2).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, longs), pa.nulls(1, pa.int32()), pa.nulls(1, longs), pa.nulls(1, longs), pa.array([out], ints), pa.array([n[out]], ints)], names=names)

    return rows.mapInArrow(run, _PRINT)


def _frequent(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counters that stand out within some task, and their sums: at most 2^COUNTERS numbers."""
    each = found.filter("slots is not null").select(F.explode(F.arrays_zip("slots", "times")).alias("x"))
    out = each.groupBy(F.col("x.slots").alias("slot")).agg(F.least(F.sum(F.col("x.times").cast("bigint")), F.lit(1 << 30)).cast("int").alias("n")).toArrow()
    return out.column("slot").to_numpy(), out.column("n").to_numpy()


def _shared(batches):
    """Of rows sorted by (key, node), the distinct ones whose key has another node."""
    held = None
    for batch in itertools.chain(batches, [None]):
        table = pa.Table.from_batches([x for x in (held, batch) if x is not None]) if batch is not None or held is not None else None
        if table is None or not table.num_rows:
            continue
        rows = table.combine_chunks().to_batches()[0]
        key, node = (rows.column(c).to_numpy() for c in ("key", "node"))
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        rows = rows.filter(pa.array(new))
        key, joined = rows.column("key").to_numpy(), rows.column("joined").to_numpy(zero_copy_only=False)
        same = key[1:] == key[:-1]
        before, after = np.append(False, same) | joined, np.append(same, False)
        done = len(key) if batch is None else len(key) - 1
        yield rows.slice(0, done).filter(pa.array((before | after)[:done]))
        last = rows.slice(len(key) - 1)
        held = last.set_column(last.schema.get_field_index("joined"), "joined", pa.array([bool(before[-1])]))


def rare_first(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray], similarity: float, shingle: int) -> DataFrame:
    """(key, node, size, pos): each text's rarest shingles, where another text has them among its rarest too.

    Two sets with a Jaccard similarity of `similarity` always share one of the first
    `size - similarity * size + 1` members of each, in whatever order, if it is one for
    all texts. By counters, rare ones come first here, so that few other texts share them.
    """
    slots, times = frequent

    def run(batches):
        often = np.zeros(1 << COUNTERS, np.int32)
        often[slots] = times
        seen: set[int] = set()
        for batch in slices(batches):
            node = batch.column("node").to_pylist()
            out = []
            for x, own in zip(node, _sets(utf8(batch.column("text")), shingle), strict=True):
                if x in seen or not len(own):
                    continue
                seen.add(x)
                order = np.lexsort((own, often[(own >> np.uint64(64 - COUNTERS)).astype(np.int64)]))
                first = len(own) - int(np.ceil(similarity * len(own) - 1e-6)) + 1
                out.append((own[order[:first]].view(np.int64), x, len(own)))
            if out:
                sizes = np.asarray([len(x[0]) for x in out])
                pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                columns = [np.concatenate([x[0] for x in out]), np.repeat(np.asarray([x[1] for x in out], np.int64), sizes), np.repeat([x[2] for x in out], sizes).astype(np.int32), pos.astype(np.int32)]
                yield from pa.Table.from_arrays([*map(pa.array, columns), pa.array(np.zeros(len(pos), bool))], names=["key", "node", "size", "pos", "joined"]).to_batches(1 << 16)

    schema = "key bigint, node bigint, size int, pos int, joined boolean"
    found = rows.select("node", "text").mapInArrow(run, schema)
    return found.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, schema).drop("joined")


def node_of(text: Column) -> Column:
    """The same number for copies; texts without words are copies of each other.

    Of 10^10 different texts two or three are expected to share a number by chance.
    """
    return F.xxhash64(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(""))


def _may_reach(similarity: float, a: str, b: str):
    """Whether two sets that share a member at these places may be as similar: what stands before and after it bounds what they share."""
    s, t, i, j = (F.col(f"{x}.{c}") for c in ("size", "pos") for x in (a, b))
    most = F.least(i, j) + 1 + F.least(s - i - 1, t - j - 1)
    return most >= similarity * (s + t - most) - 1e-6


def _unequal(entries: DataFrame, comps: DataFrame, turn: int, kept: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows with their components, and the keys in which several meet: members, those of the largest component, a hub that changes by turn.

    Of keys with the same members one stays, as every one of them gives the same pairs: a bound
    on what two sets share holds at any member that they share. Members are told by 128 bits.
    """
    at = entries.join(comps, "node", "left").select("key", "node", "size", "pos", F.coalesce("component", "node").alias("comp"))
    at = kept.write(at, "entries")
    hub = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "size", "pos", "comp")).alias("hub")
    same = ["m1", "m2"]
    groups = at.groupBy("key", "comp").agg(F.count("*").alias("n"), hub, *(F.bit_xor(F.xxhash64(F.lit(m), "node")).alias(m) for m in same))
    keys = groups.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("comp", F.struct("n", "comp")).alias("major"), F.min("hub").alias("hub"), *(F.bit_xor(m).alias(m) for m in same)).filter("n > top")
    keys = keys.groupBy("n", *same).agg(F.min(F.struct("key", "top", "major", "hub")).alias("k")).select("n", "k.*")
    return at, kept.write(keys, "keys")


def _hub_pairs(at: DataFrame, keys: DataFrame, similarity: float) -> DataFrame:
    """Each key's hub with the members of other components."""
    met = at.select("key", F.struct("node", "size", "pos", "comp").alias("x")).join(keys.select("key", "hub"), "key")
    return met.filter((F.col("x.comp") != F.col("hub.comp")) & _may_reach(similarity, "x", "hub")).select(F.col("x.node").alias("a"), F.col("hub.node").alias("b"))


def _all_pairs(at: DataFrame, keys: DataFrame, nodes: DataFrame, similarity: float, block: int) -> DataFrame:
    """The pairs of a key that lie in different components and that sketches don't rule out; one of a pair always lies outside the key's largest component.

    Long texts are told apart by wide sketches, as brief ones are full. A pair that shares many
    keys is made at the first of them, and later ones leave it out if they see an earlier one that
    both have; each member sees EARLIER of them, so that few pairs are made twice and none is missed.
    """
    blocks = F.ceil((F.col("n") - F.col("top")) / block).cast("int")
    brief = nodes.select("node", F.slice("brief", BRIEF + 1, WIDE).alias("wide"), *(F.get("brief", F.lit(k)).alias(f"s{k}") for k in range(BRIEF)))
    met = at.join(keys.select("key", "major", blocks.alias("blocks")), "key").join(brief, "node")
    met = met.withColumn("earlier", F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(-EARLIER, -1)))
    met = met.select("key", "blocks", F.struct("node", "size", "pos", "comp", (F.col("comp") != F.col("major")).alias("minor"), *(f"s{k}" for k in range(BRIEF)), "wide", "earlier").alias("x"))
    first = met.filter("x.minor").select("key", F.pmod(F.xxhash64("x.node"), "blocks").cast("int").alias("block"), F.col("x").alias("p"))
    second = met.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("x").alias("q"))
    once = ~F.col("q.minor") | (F.col("p.node") < F.col("q.node"))
    total = F.col("p.size") + F.col("q.size")
    differ = sum((F.bit_count(F.col(f"p.s{k}").bitwiseXOR(F.col(f"q.s{k}"))) for k in range(BRIEF)), F.lit(0))
    alike = lambda differ: (total - differ) / 2 >= similarity * (total - (total - differ) / 2) - 1e-6
    new = ~F.arrays_overlap("p.earlier", "q.earlier")
    same = (first["key"] == second["key"]) & (first["block"] == second["block"]) & (F.col("p.comp") != F.col("q.comp"))
    pairs = first.join(second, same & once & _may_reach(similarity, "p", "q") & alike(differ) & new & alike(_differing("p.wide", "q.wide")))
    return pairs.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, tables: int = TABLES, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK >> 3) -> DataFrame:
    """(doc_id, node, component_id, first) of every row with an id: texts joined by chains of pairs whose sets of five-word shingles have a Jaccard similarity of at least `similarity`.

    Fingerprints of five-word shingles differ in far more than four bits at that
    similarity, so pairs are proposed by several fingerprints of word pairs, linked at four
    bits by the Golay keys, and each proposed pair is confirmed on its whole shingle
    sets. That joins most copies early, but misses pairs; the rest are proposed by
    `rare_first`, which misses none: keys in which several components meet compare a hub
    with all others and are looked at again while that joins many, and at last every pair
    of a key that lies in different components is compared. Sketches rule out most
    proposals before that: sets whose sketches differ in too many bits can't be alike.

    Copies are one node. Null, empty and wordless texts are alike. component_id is the
    smallest doc_id of a component, and `first` marks the rows of its smallest (doc_id,
    node). Rows that share an id but not a text are texts of their own; rows without
    an id take no part and aren't returned.
    """
    if similarity < 0.5:
        raise ValueError("sketches are compared down to a similarity of 0.5")
    kept = Scratch(docs.sparkSession, "similar-groups")

    def sets(batches):
        for batch in slices(batches):
            own = _sets(utf8(batch.column("text")), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["node", "own"])

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs that their sketches don't rule out."""
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        both = both.filter(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6)
        common = (F.col("na") + F.col("nb") - _differing("sa", "sb")) / 2
        return both.filter(common >= similarity * (F.col("na") + F.col("nb") - common) - 1e-6).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs whose whole sets are alike; only their texts are read into sets."""
        pairs = kept.write(likely(pairs), "likely")
        # written, so that Spark knows its size when it chooses how to join
        involved = kept.write(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select(F.col("low").alias("doc_id"), "node"), "involved")
        texts = rows.join(involved, ["doc_id", "node"], "left_semi").select("node", "text")
        # rows that agree in id and text count once
        own = kept.write(texts.mapInArrow(sets, "node bigint, own array<bigint>").groupBy("node").agg(F.first("own").alias("own")), "sets")
        both = join_one(pairs, own.select(F.col("node").alias("a"), F.col("own").alias("sa")), ["a"], "b")
        both = join_one(both, own.select(F.col("node").alias("b"), F.col("own").alias("sb")), ["b"], "a", counts=pairs.groupBy("b").agg(F.count("*").alias("n")))
        common = F.size(F.array_intersect("sa", "sb"))
        alike = both.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("n")).filter(F.col("c") >= similarity * (F.col("n") - F.col("c")) - 1e-6)
        out = kept.write(alike.select("a", "b"), "alike")
        kept.drop(pairs, involved, own)
        return out

    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    rows = id_and_text(docs, id_col, text_col).filter("doc_id is not null").select("doc_id", node_of(F.col("text")).alias("node"), "text")
    found = kept.write(_printed(rows, tables, shingle), "fingerprints")
    frequent, found = _frequent(found), found.filter("doc_id is not null")
    nodes = kept.write(found.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("fps").alias("fps"), F.min("size").alias("size"), F.min("sketch").alias("sketch"), F.min("brief").alias("brief")), "nodes")
    each = kept.write(nodes.select("node", F.posexplode("fps").alias("tab", "fp")), "each")
    reps = kept.write(each.groupBy("tab", "fp").agg(F.min("node").alias("rep")), "representatives")
    links = link_fingerprints(reps, kept=kept)
    first = reps.select("tab", F.col("fp").alias("u"), F.col("rep").alias("a"))
    second = reps.select("tab", F.col("fp").alias("v"), F.col("rep").alias("b"))
    pairs = links.join(first, ["tab", "u"]).join(second, ["tab", "v"]).select("a", "b")
    same = join_one(each, reps, ["tab", "fp"], "node").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    tested = kept.write(pairs.union(same).filter("a != b").select(*ordered).distinct(), "pairs")
    kept.drop(each, reps)
    alike = confirmed(tested)
    entries = kept.write(rare_first(rows, frequent, similarity, shingle), "rare-first")
    left = None
    for turn in itertools.count():
        before_turn = entries
        entries, keys = _unequal(entries, connected_components(alike, "a", "b"), turn, kept)
        kept.drop(before_turn)
        before = left
        left, members = keys.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - F.col("top"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not left:
            break
        # hubs go on only while they at least halve what would be compared
        whole = left <= 4 * members or (before is not None and 2 * left > before)
        new = _all_pairs(entries, keys, nodes, similarity, block) if whole else _hub_pairs(entries, keys, similarity)
        new = kept.write(new.select(*ordered).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        alike = alike.union(confirmed(new))
        if whole:
            break
        tested = tested.union(new)
        last = entries
        entries = kept.write(entries.join(keys, "key", "left_semi").drop("comp"), "entries")
        kept.drop(last, keys)
    comps = connected_components(alike, "a", "b")
    linked = kept.write(comps.join(nodes.select("node", "low"), "node"), "linked")
    least = linked.groupBy("component").agg(F.min(F.struct(F.col("low"), F.col("node").alias("of"))).alias("least"))
    named = join_one(linked, least, ["component"], "node").select("node", "least")
    own = F.struct(F.col("low"), F.col("node").alias("of"))
    labels = nodes.join(named, "node", "left").select("node", F.coalesce("least", own).alias("least"))
    out = kept.write(join_one(found.select("doc_id", "node"), labels, ["node"], "doc_id").select("doc_id", "node", F.col("least.low").alias("component_id"), ((F.col("doc_id") == F.col("least.low")) & (F.col("node") == F.col("least.of"))).alias("first")), "groups")
    kept.drop(*(x for x in kept.tables if x is not out))
    return out
