"""Best-fit packing of tokenised documents into sequences of a fixed length.

Pieces are dealt to groups by hash. Each group packs best-fit decreasing and gets a lower
bound on its number of sequences from dual-feasible functions. Where the two agree the group
is certified: alone it can't do better, so it keeps its sequences, but for the loosest ones,
which other groups' pieces may still fill. Groups with a gap give up all their pieces. What
was given up is dealt to new groups and packed anew, until the count meets the bound of all
pieces together, a round doesn't lower it, or the rounds are used up.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrilith.llm.bpe import CACHE_PIECES, encoder
from metrilith.llm.common import id_and_text, slices, strings
from metrilith.operators.tables import Scratch

CAPACITY = 2048
#: Pieces in a group, on average; a group is packed in one task.
GROUP_PIECES = 4096
#: Sequences of certified groups with at least this much room give up their pieces for the next round.
ROOM = 32
ROUNDS = 4

_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PLACED = _PIECE + ", row bigint, sequence_id bigint, offset bigint, room int, bins int, bound int"


def cut_pieces(docs: DataFrame, tokenizer: str, cut: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE_PIECES) -> DataFrame:
    """Tokenise whole texts, append `end_id`, cut what is longer than `capacity`.

    All pieces of a cut document but the first have `capacity` ids. A null or empty text
    is a document of the end id alone; repeated rows are documents of their own.
    """

    def pieces(batches):
        enc = encoder(tokenizer, cut, cache)
        end = np.asarray([end_id], enc.dtype).tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, coded in zip(batch.column("doc_id").to_pylist(), enc.encode(strings(batch.column("text"))), strict=True):
                ids = np.frombuffer(coded + end, enc.dtype).astype("<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                rows += ((doc_id, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False)))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        enc.trim()

    return id_and_text(docs, id_col, text_col).mapInArrow(pieces, _PIECE)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each length's sequence and offset, and each sequence's room.

    The open sequences are kept by their room; one bit for each room that occurs makes
    the tightest fit the lowest set bit above the length.
    """
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room: list[int] = []
    mask = 0
    for k, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> length
        if fits:
            r = length + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        where[k], offset[k] = b, capacity - r
        room[b] = left = r - length
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return where, offset, np.asarray(room, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most that two families of dual-feasible functions prove.

    One takes lengths over capacity - k as whole, leaves those from k on and drops the
    rest, for k up to capacity / 2; the other rounds length * (k + 1) / capacity down to
    k-ths, whole multiples staying.
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """The same from how many pieces there are of each length."""
    if not count.any():
        return 0
    size = np.arange(capacity + 1)
    n_from = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])
    sum_from = np.concatenate([np.cumsum((count * size)[::-1])[::-1], [0]])
    k = np.arange(0, capacity // 2 + 1)
    top = capacity - k + 1
    best = int(np.max(-(-((n_from[top] * capacity) + sum_from[k] - sum_from[top]) // capacity)))
    for j in range(1, 33):
        exact = size * (j + 1) % capacity == 0
        # in units of 1 / (j * capacity)
        value = np.where(exact, size * j, size * (j + 1) // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (j * capacity)))
    return best


def sequence_ids(group: int, round_no: int, local: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the sequences of a group and round: 46 bits of group, 3 of round and 14 of place.

    Rows are dealt to groups of GROUP_PIECES on average by a hash of distinct numbers, so that
    none comes near 2^14 pieces; one that did stops the task.
    """
    if len(local) and (int(local.max()) >> 14 or round_no >> 3 or group >> 46):
        raise OverflowError("a group's sequences don't fit their numbers")
    return (group << 17 | round_no << 14) + local.astype(np.int64)


def _pack_groups(pieces: DataFrame, n: int, round_no: int, capacity: int) -> DataFrame:
    """One round over `n` pieces, in groups."""
    groups = max(1, -(-n // GROUP_PIECES))
    seed = F.lit(round_no)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        where, offset, room = best_fit(lengths, capacity)
        return pdf.assign(sequence_id=sequence_ids(int(key[0]), round_no, where), offset=offset, room=room[where].astype("int32"), bins=np.int32(len(room)), bound=np.int32(lower_bound(lengths, capacity)))[_COLUMNS]

    key = F.pmod(F.xxhash64("row", seed), F.lit(groups)).alias("g")
    return pieces.select(key, *_COLUMNS[:6]).groupBy("g").applyInPandas(pack, _PLACED)


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "row", "sequence_id", "offset", "room", "bins", "bound"]


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Place every piece: its sequence and offset, and its group's count and bound.

    A group with bins = bound is certified. An empty table gives an empty result. Equal
    lengths are taken in ascending (doc_id, piece) order; pieces that agree in all are
    dealt out like any others.
    """
    kept = Scratch(pieces.sparkSession, "packing")
    pieces = kept.write(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = pieces.filter(F.col("length") == capacity)
    rest = pieces.filter(F.col("length") < capacity)
    # a piece of full length is a sequence by itself, numbered below zero
    done = [whole.select(*_COLUMNS[:6], (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(0).alias("room"), F.lit(1).alias("bins"), F.lit(1).alias("bound"))]
    count = np.zeros(capacity + 1, np.int64)
    for length, times in rest.groupBy("length").count().collect():  # fewer rows than `capacity`
        count[length] = times
    least = bound_of_counts(count, capacity)
    sequences = lambda df: df.filter("offset = 0").count()
    current = kept.write(_pack_groups(rest, int(count.sum()), 0, capacity), "packed")
    total = sequences(current)
    given = (F.col("bins") > F.col("bound")) | (F.col("room") >= ROOM)
    for round_no in range(1, rounds + 1):
        loose = current.filter(given)
        bins = sequences(loose)
        if total <= least or bins < 2:
            break
        again = kept.write(_pack_groups(loose, loose.count(), round_no, capacity), "packed")
        fewer = bins - sequences(again)
        if fewer <= 0:
            break
        done.append(current.filter(~given))
        current = again
        total -= fewer
    done.append(current)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, cut: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE_PIECES) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(cut_pieces(docs, tokenizer, cut, end_id, capacity, id_col, text_col, cache), capacity)
