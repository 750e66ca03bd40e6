"""Written intermediate tables, and joins that a frequent key doesn't slow down."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The temporary folder of a local session that names no shared one.
_OWN: list[str] = []
#: Folders of tables that results may still read.
_HELD: dict[str, SparkSession] = {}
#: Settings that hold while a table is written: its shuffle files go with its end, and
#: Python tasks get their rows in batches of at most a few megabytes.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: A key is frequent if it holds more than one in so many rows: there are always fewer such keys than this.
SHARE = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a local session that names none gets a temporary folder; on a cluster each
    executor would write to a disk of its own, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='metrilith-')}")
        root = _OWN[0]
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one operator's run, written to the shared folder and read back.

    Lineage ends at a written table: lost executors cost a re-read, not a recomputation,
    and a Python stage that several branches use runs once. A write's shuffle files go as
    soon as it is done; `drop` removes tables that nothing reads any more. What a result
    reads stays until the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/metrilith/{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.tables: list[DataFrame] = []  # keeps their identities
        _HELD[self.root] = spark

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.tables)}"
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in _WRITING}
        for k, v in _WRITING.items():
            conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append(out)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove tables that `write` returned; others are left alone."""
        for x in tables:
            if path := self.paths.pop(id(x), None):
                _remove(self.spark, path)


@atexit.register
def _remove_held() -> None:
    for path, spark in _HELD.items():
        with contextlib.suppress(Exception):  # the session may have ended before
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)


def join_one(many: DataFrame, one: DataFrame, keys: list[str], spread: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join `many` with `one`, which has a row for each key at most; a key with a large share of `many` is dealt out.

    Keys with over one in SHARE rows are looked up first (fewer than SHARE of them). Their
    rows are spread by the hash of column `spread`, and their row of `one` is repeated as
    often. `counts` holds the keys with their numbers of rows as `n`, if they are known (those
    of rare keys may be left out); else `many` is counted, so it should be a written
    table. Null keys don't join.
    """
    if counts is None:
        counts = many.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.filter(F.col("n") > max(total // SHARE, 1 << 10))
    heavy = often.select(*keys, F.least(F.ceil(F.col("n") * SHARE / max(total, 1)), F.lit(SHARE)).cast("int").alias("__parts")).collect()
    if not heavy:
        return many.join(one, keys, how)
    schema = many.select(*keys, F.lit(0).alias("__parts")).schema
    parts = F.broadcast(many.sparkSession.createDataFrame(heavy, schema))
    left = many.join(parts, keys, "left").withColumn("__part", F.pmod(F.xxhash64(spread), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    right = one.join(parts, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [*keys, "__part"], how).drop("__part")
