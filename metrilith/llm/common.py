"""Helpers that every corpus operator shares."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrilith.operators.tables import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark has to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """`df` as a written table of its own in the shared folder."""
    return Scratch(df.sparkSession, label).write(df, "table")


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators need, under names of their own.

    Other columns, whatever their names, never meet the operator's own columns.
    """
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batches, column: str = "text", size: int = 1 << 20, rows: int = 2048):
    """The batches cut to runs of rows with about `size` bytes in `column` (one row at least) and at most `rows` rows.

    What a task holds as Python objects is bounded by this, not by Arrow's batches.
    """
    for batch in batches:
        length = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(length, length[at] + size, "left"))
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; a null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The values of a string column; a null is empty."""
    return [x or "" for x in column.to_pylist()]
