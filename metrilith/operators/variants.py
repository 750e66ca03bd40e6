"""Variants of a method run over the same rows, with a record of the run.

All variants come from one plan that reads its rows once and writes them beside each other, a
row for each row; each variant's columns go from there to its own folder. What the record
says is counted while they are written, not by another pass over the result.
"""

from __future__ import annotations

import json
import platform
import re
import sys
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from metrilith.operators.tables import Scratch

#: A row of the record: a variant's rows, and how many of them hold each observed condition.
Record = dict[str, dict[str, int]]


def expanded(rows: DataFrame, variants: dict[str, dict[str, Column]], keep: list[str], label: str = "method") -> DataFrame:
    """Each row once for each variant: `label` holds the variant's name, whatever the row's own is, then `keep`, then the variant's columns.

    All variants have columns of the same names and types.
    """
    each = F.array(*(F.struct(F.lit(name).alias(label), *(c.alias(k) for k, c in columns.items())) for name, columns in variants.items()))
    kept = [c for c in keep if c != label]
    return rows.select(*kept, F.inline(each))


def run(rows: DataFrame, variants: dict[str, dict[str, Column]], keep: list[str], conditions: dict[str, Column], path: str, label: str = "method") -> Record:
    """Write all variants below `path`, in a folder for each, and return what was counted meanwhile.

    Counts are rows, and rows that hold each of `conditions`, by variant; a variant without
    rows counts zero.
    """
    seen = Observation("variants")
    kept = [c for c in keep if c != label]
    # all variants beside each other, counted a row at a time: the work of counting grows with variants, not with their square
    wide = rows.select(*(F.col(c).alias(f"__k{j}") for j, c in enumerate(kept)), *(c.alias(f"__v{i}:{k}") for i, columns in enumerate(variants.values()) for k, c in columns.items()))
    plain = wide.columns

    def one(df: DataFrame, i: int, name: str, *more: str) -> DataFrame:
        own = (F.col(f"__v{i}:{k}").alias(k) for k in variants[name])
        return df.select(*more, *(F.col(f"__k{j}").alias(c) for j, c in enumerate(kept)), *own)

    for i, name in enumerate(variants):
        held = wide.columns
        wide = one(wide, i, name, *held).withColumn(label, F.lit(name)).select(*held, *(c.alias(f"__c{i}:{k}") for k, c in conditions.items()))
    counts = [F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c)).alias(c) for c in wide.columns if c.startswith("__c"))]
    scratch = Scratch(rows.sparkSession, "variants")
    beside = scratch.write(wide.observe(seen, *counts).select(*plain), "beside")
    for i, name in enumerate(variants):
        one(beside, i, name).write.parquet(f"{path}/{label}={_folder(name)}")
    scratch.drop(beside)
    got = seen.get
    return {name: {"n": got["n"], **{k: got[f"__c{i}:{k}"] for k in conditions}} for i, name in enumerate(variants)}


def _folder(name: str) -> str:
    """A name as Spark's readers expect it in a folder's."""
    return re.sub(r"""[\x00-\x1f"#%'*/:=?\\{\[\]^\x7f]""", lambda m: f"%{ord(m[0]):02X}", name)


def record_table(rows: DataFrame, record: Record, label: str = "method") -> DataFrame:
    """The record as a table, one row for each variant."""
    names = list(next(iter(record.values())))
    schema = f"{label} string, " + ", ".join(f"{k} bigint" for k in names)
    return rows.sparkSession.createDataFrame([(name, *(x[k] for k in names)) for name, x in record.items()], schema)


def write_summary(rows: DataFrame, record: Record, path: str, settings: dict[str, object]) -> None:
    """One JSON document of the run: its time, its settings, the libraries it ran on and what was counted."""
    spark = rows.sparkSession
    about = {"generated_at": datetime.now(UTC).isoformat(), "python": sys.version.split()[0], "spark": spark.version, "platform": platform.platform()}
    text = json.dumps({"settings": settings, "environment": about, "variants": record}, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
