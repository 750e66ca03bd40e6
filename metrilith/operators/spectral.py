"""Spectra of sliding windows, many windows of one length in one transform.

Series are cut into parts that hold the rows which their first windows reach back to. A task
reads its parts in order, in batches, and keeps the few last values of a batch for the next.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrilith.operators import stats

#: Rows of a series that one part holds, besides those before them that its first windows need.
PART = 4096


def _densities(x: np.ndarray, fs: float) -> np.ndarray:
    """One-sided densities at 0 to n / 2 of windows of n values, a row each, detrended and under a Hann window."""
    n = x.shape[1]
    at = np.arange(n) - (n - 1) / 2
    x = x - x.mean(1, keepdims=True)
    x = x - (x @ at)[:, None] / (n * (n * n - 1) / 12) * at
    h = np.fft.rfft(x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)), axis=1)
    k = np.arange(n // 2 + 1)
    twice = np.where((k == 0) | (2 * k == n), 1, 2)
    return (h.real**2 + h.imag**2) / (fs * 3 * n / 8) * twice


def _peaks(p: np.ndarray, n: int, fs: float, half_width: float) -> list[np.ndarray]:
    top = 1 + p[:, 1:].argmax(1)
    k = np.arange(p.shape[1])
    inside = np.abs(k - top[:, None]) * fs / n <= half_width
    between = (p[:, 1:] + p[:, :-1]) / 2 * (inside[:, 1:] & inside[:, :-1])
    return [top * fs / n, np.sqrt(p[np.arange(len(p)), top]), between.sum(1) * fs / n]


def parts(df: DataFrame, by: Sequence[str], order: str, value: str, most: int) -> DataFrame:
    """(by, order, __x, __i, __part): a series' values by place from 0, in parts of PART rows, each with the `most` - 1 rows before it.

    `order` is a number that differs within a series. Rows are numbered over range partitions,
    so that a series of any length is spread out. Rows without a value take no part.
    """
    rows = df.select(*by, order, F.col(value).cast("double").alias("__x")).filter("__x is not null and not isnan(__x)")
    rows = stats.placed(rows, by, [order], "__i").withColumn("__i", F.col("__i") - 1)
    part, reached = F.floor(F.col("__i") / PART), F.floor((F.col("__i") + most - 1) / PART)
    return rows.withColumn("__part", F.explode(F.array_distinct(F.array(part, reached)))).repartition(*by, "__part").sortWithinPartitions(*by, "__part", "__i")


def dominant(df: DataFrame, by: Sequence[str], order: str, value: str, fs: float, most: int = 64, least: int = 16, half_width: float = 0.5) -> DataFrame:
    """(by, order, i, frequency, amplitude, energy) of each row's window: the last `most` rows of its series, from `least` on.

    Frequency is that of the largest density above zero, the lowest of equals; amplitude its root; energy the
    densities around it, up to `half_width`, by trapezoids. `i` is the row's place from 0.
    """
    found = parts(df, by, order, value, most)
    kinds = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in [*by, order])
    kept, size = [*by, order], PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a part follow each other: a window is a stretch of rows, which may begin in the batch before
        tail = np.empty(0)
        for batch in batches:
            i = batch.column("__i").to_numpy()
            x = np.concatenate([tail, batch.column("__x").to_numpy()])
            lengths = np.where((i >= least - 1) & (i // size == batch.column("__part").to_numpy()), np.minimum(i + 1, most), 0)
            out = np.empty((3, len(i)))
            for n in np.unique(lengths[lengths > 0]):  # at most `most` of them
                at = np.flatnonzero(lengths == n)
                values = np.lib.stride_tricks.sliding_window_view(x, n)[at + len(tail) - n + 1]
                out[:, at] = _peaks(_densities(values, fs), int(n), fs, half_width)
            at = np.flatnonzero(lengths)
            picked = [batch.column(c).take(pa.array(at)) for c in kept]
            yield pa.RecordBatch.from_arrays([*picked, pa.array(i[at]), *(pa.array(v[at]) for v in out)], names=[*kept, "i", "frequency", "amplitude", "energy"])
            tail = x[max(0, len(x) - most + 1) :]

    return found.mapInArrow(run, f"{kinds}, i bigint, frequency double, amplitude double, energy double")


def consensus(spectra: DataFrame, order: str, fs: float) -> DataFrame:
    """`spectra` with consensus, the median frequency of its frame, and agreement, how near a row's own is at its resolution."""
    middle = stats.quantiles(spectra, [order], "frequency", {"consensus": 0.5})
    resolution = F.greatest(fs / (F.col("i") + 1), F.lit(0.1))
    return spectra.join(middle, order).withColumn("agreement", F.exp(-F.abs(F.col("frequency") - F.col("consensus")) / resolution))
