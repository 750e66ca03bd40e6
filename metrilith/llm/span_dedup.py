"""Substring deduplication by sliding sentence spans.

A text is cut into sentences at line ends and after sentence marks. From every sentence on,
and back from every sentence, the shortest run of several consecutive sentences with at least
WORDS words is hashed; runs in both directions cover a repeated passage to its last
sentence. (A single sentence counts as several if it has twice as many words.) Hashes are
counted over all texts, repeated runs meet their first occurrence (smallest doc_id, then
place), and the sentences of every other one are removed.

Runs are written once. What meets are 64 bits of a hash of 128; all 128 have to agree, so
that no text goes because two runs share a key by chance.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrilith.llm.common import id_and_text, slices, strings
from metrilith.operators.tables import Scratch, join_one

#: Words of a run, at least; sentences of a run, at least; words of a sentence that is a run alone.
WORDS, SENTENCES, ALONE = 24, 2, 48

_END = re.compile(r"(?<=[.!?])\s+|\n")
_RUN = "doc_id bigint, h bigint, g bigint, first int, last int"


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence that has words, in order."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def runs(text: str, words: int = WORDS, alone: int = ALONE) -> list[tuple[int, int, int, int]]:
    """(two halves of a hash, first sentence, last sentence) of all runs; hashes disregard case and white space."""
    own = [text[a:b].lower().split() for a, b in sentences(text)]
    total = np.concatenate([[0], np.cumsum([len(w) for w in own])])
    if total[-1] < words:
        return []
    n = len(own)
    at = np.arange(n)
    ahead = np.maximum(np.searchsorted(total, total[:-1] + words, "left"), at + SENTENCES)  # one past the last sentence of the run from i
    back = np.minimum(np.searchsorted(total, total[1:] - words, "right") - 1, at + 1 - SENTENCES)  # the first sentence of the run up to j
    spans = {(i, int(e)) for i, e in enumerate(ahead) if e <= n} | {(int(s), j + 1) for j, s in enumerate(back) if s >= 0}
    spans |= {(i, i + 1) for i, w in enumerate(own) if len(w) >= alone}
    joined = [" ".join(w) for w in own]
    out = []
    for a, b in sorted(spans):
        x = xxhash.xxh3_128_intdigest(" ".join(joined[a:b]))
        out.append(((x & _LOW) - (1 << 63), (x >> 64) - (1 << 63), a, b - 1))
    return out


_LOW = (1 << 64) - 1


def repeated_runs(rows: DataFrame, kept: Scratch, words: int = WORDS, alone: int = ALONE) -> DataFrame:
    """(doc_id, first, last, first_doc) of every run that repeats an earlier one."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    names = [x.split()[0] for x in _RUN.split(", ")]

    def cut(batches):
        for batch in slices(batches):
            found = [(doc_id, *x) for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")), strict=True) for x in runs(text, words, alone)]
            columns = zip(*found, strict=True) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    spans = kept.write(rows.mapInArrow(cut, _RUN), "runs")
    often = kept.write(spans.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    again = kept.write(join_one(spans, often.select("h"), ["h"], "doc_id", "left_semi", counts=often), "repeated-runs")
    kept.drop(spans, often)
    origin = again.groupBy("h", "g").agg(F.min(F.struct("doc_id", "first", "last")).alias("o"))
    met = join_one(again, origin, ["h", "g"], "doc_id")
    return met.filter(~F.struct("doc_id", "first", "last").eqNullSafe(F.col("o"))).select("doc_id", "first", "last", F.col("o.doc_id").alias("first_doc"))


def drop_repeats(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, first_docs) of every row.

    `text` is what is left: kept sentences with the white space between them as it was.
    `first_docs` are the ids where the removed passages stand first. A null text counts as
    empty; texts without a repeat come back whole. Rows without an id keep their texts, as
    nothing tells their copies apart; of rows that share an id each loses the repeats found
    in any of them, and rows that agree in id and text count as one occurrence.
    """
    rows = id_and_text(docs, id_col, text_col)
    unique = rows.filter("doc_id is not null")
    kept = Scratch(docs.sparkSession, "repeats")
    found = repeated_runs(unique, kept, words, 2 * words)
    # written, so that Spark knows its size when it chooses how to join
    cut = kept.write(found.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("cut"), F.array_sort(F.collect_set("first_doc")).alias("first_docs")), "cut")

    def remove(batches):
        for batch in slices(batches):
            out: list[str] = []
            total, gone = [], []
            for text, spans in zip(strings(batch.column("text")), batch.column("cut").to_pylist(), strict=True):
                places = sentences(text)
                removed = {k for s in spans or () for k in range(s["first"], s["last"] + 1)}
                parts, at = [], 0
                for k, (_, b) in enumerate(places):
                    end = places[k + 1][0] if k + 1 < len(places) else len(text)
                    if k not in removed:
                        parts.append(text[at:end])
                    at = end
                out.append("".join(parts) if removed else text)
                total.append(len(places)), gone.append(len(removed & set(range(len(places)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), pa.array(total, pa.int32()), pa.array(gone, pa.int32()), batch.column("first_docs")], names=["doc_id", "text", "n_sentences", "n_removed", "first_docs"])

    empty = F.array().cast("array<bigint>")
    joined = rows.join(cut, "doc_id", "left").select("doc_id", "text", "cut", F.coalesce("first_docs", empty).alias("first_docs"))
    return joined.mapInArrow(remove, "doc_id bigint, text string, n_sentences int, n_removed int, first_docs array<bigint>")
