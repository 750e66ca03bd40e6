"""One table of facts, several outputs: a stream's batches written to each output once.

A batch may be run again after a failure, and may have reached some outputs before. Each
output therefore keeps its batches in folders named by the batch's number: a batch is
written beside them, under a name that readers skip, and renamed when it is whole. A folder
that stands already is left alone, so that running a batch again writes only what is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Output = Callable[[DataFrame], DataFrame]
_KEY = ("frame_id", "point_id")


def columns(*names: str | Column) -> Output:
    """An output of some columns of the facts."""
    return lambda facts: facts.select(*names)


#: Outputs of a measurement's facts, by name.
OUTPUTS: dict[str, Output] = {
    "raw_measurements": columns("timestamp", *_KEY, "x_raw", "y_raw", "z_raw"),
    "validated_measurements": lambda facts: facts.drop("runtime_ms"),
    "final_measurements": lambda facts: facts.drop("runtime_ms"),
    "measurement_confidence": columns(*_KEY, "measurement_confidence"),
    "physics_confidence": columns(*_KEY, "physics_confidence"),
    "fault_log": columns(*_KEY, "fault_type", "fault_score", "recovery_action", "recovery_success"),
    "runtime": columns(*_KEY, "runtime_ms"),
}


class FanOut:
    """For `foreachBatch`: writes a batch of facts to all outputs below `root`, each once.

    A batch is held while it is written, so that its facts are worked out once. Renaming a
    folder has to be one step in the file system, as it is in HDFS.
    """

    def __init__(self, root: str, outputs: dict[str, Output] | None = None):
        self.root = root.rstrip("/")
        self.outputs = outputs or OUTPUTS

    def __call__(self, batch: DataFrame, batch_id: int) -> list[str]:
        """The names of the outputs that the batch was written to now."""
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        missing = [n for n in self.outputs if not files.exists(path(f"{self.root}/{n}/batch={batch_id}"))]
        if not missing:
            return []
        facts = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name in missing:
                beside, final = f"{self.root}/{name}/_batch-{batch_id}", f"{self.root}/{name}/batch={batch_id}"
                self.outputs[name](facts).write.mode("overwrite").parquet(beside)
                if not files.rename(path(beside), path(final)):
                    raise OSError(f"{final} can't be made")
        finally:
            facts.unpersist()
        return missing

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """All whole batches of one output, with the number of the batch as `batch`."""
        return spark.read.parquet(f"{self.root}/{name}")


def run(facts: DataFrame, fan: FanOut, checkpoint: str) -> None:
    """Write what a stream of facts holds now to all outputs; a later call goes on after it."""
    query = facts.writeStream.foreachBatch(lambda batch, number: fan(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def summary(fan: FanOut, spark: SparkSession) -> DataFrame:
    """(output, n, frames, points) of each output: rows, and sums of their keys."""
    parts = [fan.read(spark, n).agg(F.count("*").alias("n"), F.sum("frame_id").alias("frames"), F.sum("point_id").alias("points")).select(F.lit(n).alias("output"), "n", "frames", "points") for n in fan.outputs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
