"""Token-id files with Elias-Fano document boundaries.

A store is a folder of Parquet files in which a row is a block of consecutive documents:
their ids as one packed array, and two Elias-Fano sequences, one of the places where
documents end in it and one of their ids. Neither needs a table of 64-bit offsets: n
sorted numbers below u take about n * (2 + log2(u / n)) bits, and a sample of select
positions makes each of them readable on its own.

Documents stand in ascending doc_id order (equal ids by the hash of their texts, null ids
first) over all blocks of all files, so that a document's place in the whole store is the
total of the parts before its own, plus its block's place there, plus its place in the block.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrilith.llm.bpe import encoder
from metrilith.llm.common import id_and_text, slices, strings
from metrilith.operators.tables import shared_dir

#: A block is closed when it holds so many ids or documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 1 << 16
#: One select position is kept for so many numbers.
SAMPLE = 64

_EF = "struct<n:int,low_bits:int,low:binary,high:binary,sample:binary>"
_BLOCK = f"part int, block int, first bigint, n_ids bigint, n_null int, base bigint, width int, ids binary, ends {_EF}, doc_ids {_EF}"


class EliasFano:
    """A sorted sequence of n numbers >= 0."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, sample: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.sample = np.frombuffer(sample, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1, np.uint8)
        high[places] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: np.ndarray) -> np.ndarray:
        """Places of the i-th set bits of the upper part: each is found from its nearest sample on, byte by byte."""
        i = np.asarray(i, np.int64)
        high = np.frombuffer(self.high, np.uint8)
        at, left = self.sample[i // SAMPLE].astype(np.int64), i % SAMPLE
        byte = at >> 3
        word = (high[byte].astype(np.int64) >> (at & 7)) << (at & 7)
        live = np.arange(len(i))
        while len(live):
            here = np.bitwise_count(word[live]).astype(np.int64)
            live, here = live[beyond := left[live] >= here], here[beyond]
            left[live] -= here
            byte[live] += 1
            word[live] = high[byte[live]]
        while len(live := np.flatnonzero(left)):
            word[live] &= word[live] - 1
            left[live] -= 1
        return 8 * byte + np.bitwise_count((word & -word) - 1)

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        window = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3], "little")
        return (window >> (at & 7)) & ((1 << self.low_bits) - 1)

    def take(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers; no others are decoded."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        if self.low_bits > 56:  # more than an eight-byte window holds
            low = np.asarray([self._low(int(x)) for x in i], np.int64)
        else:
            windows = np.ndarray(len(self.low) + 1, "<u8", self.low + b"\0" * 8, strides=(1,))
            at = i * self.low_bits
            low = (windows[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64) & ((1 << self.low_bits) - 1)
        return ((self.select(i) - i) << self.low_bits) | low

    def __getitem__(self, i: int) -> int:
        return int(self.take(np.asarray([i]))[0])

    def row(self) -> dict:
        return {"n": self.n, "low_bits": self.low_bits, "low": self.low, "high": self.high, "sample": self.sample.tobytes()}


def write_store(docs: DataFrame, path: str, tokenizer: str, cut: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all `docs` to the folder `path`.

    A null text counts as empty; an empty text has only the end id. Repeated rows are
    documents of their own. An empty table makes a store without blocks.
    """

    def blocks(batches):
        enc, part = encoder(tokenizer, cut), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.asarray([end_id], enc.dtype).tobytes()
        width = np.dtype(enc.dtype).itemsize
        ids: list[bytes] = []
        names: list[int | None] = []
        held = first = block = 0

        def close():
            nonlocal ids, names, held, first, block
            ends = np.cumsum([len(x) // width for x in ids])
            known = [x for x in names if x is not None]
            base = known[0] if known else 0
            row = {"part": part, "block": block, "first": first, "n_ids": held, "n_null": len(names) - len(known), "base": base, "width": width, "ids": b"".join(ids), "ends": EliasFano.encode(ends).row(), "doc_ids": EliasFano.encode(np.asarray([x - base for x in known], np.uint64)).row()}
            first, block = first + held, block + 1
            ids, names, held = [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in slices(batches):
            for doc_id, coded in zip(batch.column("doc_id").to_pylist(), enc.encode(strings(batch.column("text"))), strict=True):
                ids.append(coded + end)
                names.append(doc_id)
                held += len(ids[-1]) // width
                if held >= BLOCK_IDS or len(ids) >= BLOCK_DOCS:
                    yield close()
        enc.trim()
        if ids:
            yield close()

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(_BLOCK))
    tie = F.xxhash64("text")
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    rows.mapInArrow(blocks, _BLOCK).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a store, from its files.

    The totals of the parts, one number for each task that wrote, are the only thing that
    goes through the driver.
    """

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                ends, names = EliasFano(**row["ends"]), EliasFano(**row["doc_ids"])
                starts = np.append(0, ends.take(np.arange(ends.n - 1)))
                ends = ends.take(np.arange(ends.n))
                names = names.take(np.arange(names.n)) + row["base"]
                wide = memoryview(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(len(ends), row["part"], np.int32)),
                        "doc_id": pa.array([None] * row["n_null"] + names.tolist(), pa.int64()),
                        "place": pa.array(row["first"] + starts),
                        "n_tokens": pa.array(ends - starts),
                        "ids_crc32": pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    }
                )

    stored = spark.read.schema(_BLOCK).parquet(path)
    totals = sorted(stored.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, offsets = 0, []
    for part, n in totals:
        offsets.append((part, before))
        before += n
    offsets = spark.createDataFrame(offsets, "part int, before bigint")
    found = stored.mapInArrow(documents, "part int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    # one row for each writing task
    return found.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def new_store(spark: SparkSession) -> str:
    """A fresh folder for a store in the shared folder."""
    return f"{shared_dir(spark)}/metrilith/token-store-{uuid.uuid4().hex}"
