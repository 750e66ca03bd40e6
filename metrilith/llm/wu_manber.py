"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A test item's patterns are its runs of ten consecutive words (a shorter item is one
pattern). The search looks at the last two words of a ten-word window: a block shift table
tells how far the window can move without missing a pattern, so that most positions are
never looked at; where the shift is zero, the bucket of that block holds the few patterns
that end in it, and direct comparison confirms an occurrence.

The tables are broadcast. Their size goes by the number of patterns, which is counted first:
beyond WINDOWS of them the items, long ones in overlapping stretches, are dealt to several
sets of tables and the documents are searched once with each.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrilith.llm.common import id_and_text, slices, utf8
from metrilith.operators.tables import Scratch

WINDOW = 10
#: Patterns in one broadcast set of tables: some 200 bytes each in every worker.
WINDOWS = 200_000
#: Patterns that a stretch of an item gives at most.
STRETCH = 4096

#: Bytes to word bytes: A-Z in lower case; letters, digits and all beyond ASCII stay; others part words.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_FOUND = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, items array<bigint>, hits array<struct<first:int,last:int>>"


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(_WORD).split()


class WuManber:
    """Patterns of one length, in words; `stretches` are (item, words), each run of `m` words is a pattern."""

    def __init__(self, stretches: list[tuple[int, list[bytes]]], m: int):
        self.m = m
        self.far = max(m - 1, 1)
        self.number: dict[bytes, int] = {}
        self.words = array("i")
        self.shift: dict[tuple[int, int], int] = {}
        #: by the last two words, then the first: (place of a pattern in `words`, its items)
        self.bucket: dict[tuple[int, int], dict[int, list[tuple[int, tuple[int, ...]]]]] = {}
        items_of: dict[bytes, tuple[int, set[int]]] = {}
        for item, words in stretches:
            base = len(self.words)
            self.words.extend(self.number.setdefault(w, len(self.number)) for w in words)
            for at in range(base, len(self.words) - m + 1):
                items_of.setdefault(self.words[at : at + m].tobytes(), (at, set()))[1].add(item)
            for end in range(base + min(m, 2) - 1, len(self.words)):
                # the pattern that ends soonest after this pair of words
                first_end = max(end, base + m - 1)
                if first_end - end < self.shift.get(self._pair(end), self.far):
                    self.shift[self._pair(end)] = first_end - end
        shared: dict[tuple[int, ...], tuple[int, ...]] = {}
        for at, items in items_of.values():
            own = tuple(sorted(items))
            self.bucket.setdefault(self._pair(at + m - 1), {}).setdefault(self.words[at], []).append((at, shared.setdefault(own, own)))

    def _pair(self, end: int) -> tuple[int, int]:
        return (self.words[end - 1] if self.m > 1 else -1, self.words[end])

    def occurrences(self, words: list[bytes]):
        """(first word, items) of every occurrence, in order."""
        m, far, shift, bucket, number = self.m, self.far, self.shift, self.bucket, self.number.get
        at, n = m, len(words)
        while at <= n:
            last = number(words[at - 1])
            if last is None:  # no pattern holds this word
                at += m
                continue
            before = number(words[at - 2]) if m > 1 else -1
            pair = (before, last)
            s = shift.get(pair, far)
            if s:
                at += s
                continue
            found = bucket[pair].get(number(words[at - m])) if pair in bucket else None
            if found:
                own = array("i", (number(w, -1) for w in words[at - m : at]))
                for p, items in found:
                    if self.words[p : p + m] == own:
                        yield at - m, items
            at += 1


def stretches_of(item_id: int, text: bytes, window: int, longest: int = STRETCH) -> list[tuple[int, int, list[bytes]]]:
    """(item, pattern length, words): overlapping stretches of an item with at most `longest` patterns each."""
    words = words_of(text)
    m = min(window, len(words))
    return [(item_id, m, words[k : k + longest + m - 1]) for k in range(0, len(words) - m + 1, longest)] if m else []


def matchers(stretches: list[tuple[int, int, list[bytes]]]) -> list[WuManber]:
    """One matcher for each pattern length; nearly always one of WINDOW words alone."""
    by_length: dict[int, list] = {}
    for item_id, m, words in stretches:
        by_length.setdefault(m, []).append((item_id, words))
    return [WuManber(x, m) for m, x in sorted(by_length.items())]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [first, last] joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _found(matching: list[WuManber], words: list[bytes]) -> tuple[set[int], list[tuple[int, int]]]:
    """The items whose patterns occur, and the covered runs of words."""
    seen: set[int] = set()
    spans: list[tuple[int, int]] = []
    for w in matching:
        for at, ids in w.occurrences(words):
            seen.update(ids)
            spans.append((at, at + w.m - 1))
    return seen, _merged(spans)


def _sets_of_tables(items: DataFrame, window: int, windows: int) -> list:
    """Broadcast sets of matchers with about `windows` patterns each; the items of one set at a time pass the driver."""
    spark = items.sparkSession

    def cut(batches):
        for batch in slices(batches):
            rows = [x for i, t in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text")), strict=True) for x in stretches_of(i, t, window)]
            yield pa.RecordBatch.from_pylist([{"item_id": i, "m": m, "n": len(w) - m + 1, "words": b" ".join(w).decode()} for i, m, w in rows], schema=schema)

    schema = pa.schema([("item_id", pa.int64()), ("m", pa.int32()), ("n", pa.int32()), ("words", pa.string())])
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null")
    kept = Scratch(spark, "items")
    cuts = kept.write(rows.mapInArrow(cut, "item_id bigint, m int, n int, words string"), "stretches")
    groups = -(-(cuts.agg(F.sum("n")).first()[0] or 0) // windows)
    out = []
    for k in range(groups):
        own = cuts.filter(F.pmod(F.xxhash64("words"), F.lit(groups)) == k).select("item_id", "m", "words").collect()
        out.append(spark.sparkContext.broadcast(matchers([(r.item_id, r.m, r.words.encode().split(b" ")) for r in own])))
    kept.drop(cuts)
    return out


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _spans(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"first": a, "last": b} for a, b in x] for x in spans], _SPANS)


def _searched(rows: DataFrame, shared: list, kept: Scratch) -> DataFrame:
    """(row, items, hits) of the rows of `rows` (row, text) in which anything is found, once for each set of tables that finds it."""

    def search(tables):
        def run(batches):
            for batch in slices(batches):
                own = [(r, *_found(tables.value, words_of(t))) for r, t in zip(batch.column("row").to_pylist(), utf8(batch.column("text")), strict=True)]
                own = [x for x in own if x[2]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array([sorted(x[1]) for x in own], pa.list_(pa.int64())), _spans([x[2] for x in own])], names=["row", "items", "hits"])

        return run

    schema = "row bigint, items array<bigint>, hits array<struct<first:int,last:int>>"
    out = None
    for tables in shared:  # one pass after the other: a worker holds one set at a time
        part = kept.write(rows.mapInArrow(search(tables), schema), "found")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("row").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("hits")).alias("hits"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, windows: int = WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of `docs` the words that an occurrence of an item's window covers.

    `items` has item_id and text. Null and empty texts have no words: a document then has
    no hit, an item no window. Repeated rows of `docs` each give a row; items with the
    same id count once, items without one not at all. `hits` are the covered runs of words,
    ends included; `items` the ids found; the digest is that of the empty string if there
    are none.
    """
    rows = id_and_text(docs, id_col, text_col)
    shared = _sets_of_tables(items, window, windows)
    if many := len(shared) > 1:
        kept = Scratch(docs.sparkSession, "decontamination")
        rows = kept.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        rows = rows.join(_searched(rows.select("row", "text"), shared, kept), "row", "left").select("doc_id", "text", "items", "hits")
    tables = shared[0] if shared else None

    def finish(batches):
        for batch in slices(batches):
            words = [words_of(t) for t in utf8(batch.column("text"))]
            if many:
                found = [(set(i or ()), _merged([(x["first"], x["last"]) for x in h or ()])) for i, h in zip(batch.column("items").to_pylist(), batch.column("hits").to_pylist(), strict=True)]
            else:
                found = [_found(tables.value if tables else [], w) for w in words]
            ints = lambda x: pa.array(x, pa.int64())
            columns = [
                batch.column("doc_id"),
                ints([len(w) for w in words]),
                ints([sum(b - a + 1 for a, b in h) for _, h in found]),
                ints([len(i) for i, _ in found]),
                pa.array([_digest(i) for i, _ in found], pa.string()),
                pa.array([sorted(i) for i, _ in found], pa.list_(pa.int64())),
                _spans([h for _, h in found]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "items", "hits"])

    return rows.mapInArrow(finish, _FOUND)


def with_hits(docs: DataFrame, items: DataFrame, out: str = "n_hit", window: int = WINDOW, windows: int = WINDOWS, text_col: str = "text") -> DataFrame:
    """`docs` with one more column: how many words of the row's text an item's window covers. All rows and columns stay."""
    shared = _sets_of_tables(items, window, windows)
    if len(shared) > 1:
        kept = Scratch(docs.sparkSession, "decontamination")
        row, hits = f"{out}:row", f"{out}:hits"
        rows = kept.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        found = _searched(rows.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")), shared, kept)
        docs = rows.join(found.select(F.col("row").alias(row), F.col("hits").alias(hits)), row, "left").drop(row)
        # words that several sets of tables cover count once
        words = F.flatten(F.transform(F.col(f"`{hits}`"), lambda x: F.sequence(x["first"], x["last"])))
        return docs.withColumn(out, F.coalesce(F.size(F.array_distinct(words)), F.lit(0)).cast("bigint")).drop(hits)
    tables = shared[0] if shared else None

    def run(batches):
        for batch in slices(batches, text_col):
            found = [_found(tables.value if tables else [], words_of(t))[1] for t in utf8(batch.column(text_col))]
            n = pa.array([sum(b - a + 1 for a, b in h) for h in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))
