"""An index of stereo samples over a folder tree, replaced as a whole.

A build is written beside the index; then the file that names the current build is replaced in
one step. Readers see the old index or the new one, and a build that fails leaves the old one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from metrilith.sources.readers import IMAGES, SIBLINGS, samples

#: Folders of a data set whose images and truth lie in archives of their own.
ARCHIVE, SUBSET, SPLITS = "image_clean.tar", "FlyingThings3D_subset", ("train", "val", "test")
#: Adapters by rank.
ADAPTERS = (SUBSET, "generic")
#: Parts that a folder's files are dealt to.
DEALS = 32
_SAMPLE = ("dataset_name", "sequence_name", "frame_id", "left_path", "right_path", "disparity_gt_path", "disparity_scale", "official_split", "is_sequence")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below a folder, relative to it; contents aren't read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.substring(F.col("path"), F.lit(len(whole) + 2), F.length("path")).alias("path"))


def _parts(files: DataFrame) -> DataFrame:
    return files.filter("path <> ''").select("path", F.split("path", "/").alias("parts")).withColumn("last", F.element_at("parts", -1))


def _image(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.].*\.([^.]+)$", 1)).isin(*IMAGES)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]+$", "")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys over all partitions of a shuffle.

    Paths of a listing are alike and shrink to a hundredth when they are shuffled, so partitions
    must not be put together by their size there: a task would hold any number of rows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def archived_pairs(files: DataFrame) -> DataFrame:
    """Samples of the data set of archives: images of one name left and right, with truth where it is there (disparities are negative)."""
    p = _parts(files).filter((F.size("parts") == 6) & (F.get("parts", 1) == SUBSET) & F.get("parts", 2).isin(*SPLITS))
    archive, split = F.get("parts", 0), F.get("parts", 2)
    here = lambda folder, side: (F.get("parts", 3) == folder) & (F.get("parts", 4) == side)
    image = p.filter(archive.endswith(ARCHIVE) & _image(F.col("last")))
    left = image.filter(here("image_clean", "left")).select(archive.alias("archive"), split.alias("split"), F.col("last").alias("name"), F.col("path").alias("left_path"), "parts")
    right = p.filter(archive.endswith(ARCHIVE) & here("image_clean", "right")).select(archive.alias("archive"), split.alias("split"), F.col("last").alias("name"), F.col("path").alias("right_path"))
    truth = p.filter(here("disparity", "left") & F.col("last").endswith(".pfm")).select(archive.alias("source"), split.alias("split"), _stem(F.col("last")).alias("frame_id"), F.col("path").alias("disparity_gt_path"))
    met = _spread(left, "archive", "split", "name").join(_spread(right, "archive", "split", "name"), ["archive", "split", "name"]).withColumn("frame_id", _stem(F.col("name"))).withColumn("source", F.replace("archive", F.lit("image_clean"), F.lit("disparity")))
    met = _spread(met, "source", "split", "frame_id").join(_spread(truth, "source", "split", "frame_id"), ["source", "split", "frame_id"], "left")
    return met.select(
        F.lit(SUBSET).alias("dataset_name"), F.col("split").alias("sequence_name"), "frame_id", "left_path", "right_path", "disparity_gt_path",
        F.lit(-1.0).alias("disparity_scale"), F.col("split").alias("official_split"), F.lit(False).alias("is_sequence"), F.array("parts").alias("place"),
    )


def sibling_pairs(files: DataFrame, root_name: str) -> DataFrame:
    """Samples of sibling folders of any known naming, at every depth; top folders of the data set of archives are left out.

    Folder names are compared without case (of several right siblings the first by name counts),
    paths below them with it. A file below two such folders is a candidate of both.
    """
    p = _parts(files).filter(~(F.get("parts", 0).contains(SUBSET) & F.get("parts", 0).endswith(".tar") & (F.size("parts") > 1)))
    p = p.select("path", "parts", "last", F.posexplode("parts").alias("at", "folder")).filter(F.col("at") < F.size("parts") - 1)
    partner = F.create_map(*(F.lit(x) for pair in SIBLINGS.items() for x in pair))
    before, below = F.slice("parts", F.lit(1), F.col("at")), F.slice("parts", F.col("at") + 2, F.size("parts"))
    at = [before.alias("parent"), F.array_join(below, "/").alias("below")]
    left = p.filter(_image(F.col("last"))).select(*at, F.try_element_at(partner, F.lower("folder")).alias("side"), F.col("path").alias("left_path"), "parts", "folder").filter("side is not null")
    side = F.lower("folder").alias("side")
    folders = p.filter(side.isin(*SIBLINGS.values())).select(*at, side, "folder", "path")
    chosen = folders.groupBy("parent", "side").agg(F.min("folder").alias("folder"))
    # a folder may hold a large share of all files: they are dealt out, and its row repeated as often
    keys = ["parent", "side", "folder", "deal"]
    folders = folders.withColumn("deal", F.pmod(F.xxhash64("path"), F.lit(DEALS)).cast("int"))
    chosen = chosen.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    right = _spread(folders, *keys).join(_spread(chosen, *keys), keys).select("parent", "below", "side", F.col("path").alias("right_path"))
    top = F.when(F.size("parent") > 0, F.get("parent", 0)).otherwise(root_name)
    met = _spread(left, "parent", "below", "side").join(_spread(right, "parent", "below", "side"), ["parent", "below", "side"])
    return met.select(
        top.alias("dataset_name"), F.coalesce(F.try_element_at("parent", F.lit(-1)), F.lit(root_name)).alias("sequence_name"), _stem(F.col("below")).alias("frame_id"), "left_path", "right_path",
        F.lit(None).cast("string").alias("disparity_gt_path"), F.lit(1.0).alias("disparity_scale"), F.lit(None).cast("string").alias("official_split"), F.lit(False).alias("is_sequence"),
        F.array(F.concat("parent", F.array("folder")), "parts").alias("place"),
    )


def discovered(files: DataFrame, root_name: str) -> DataFrame:
    """One row for each sample_id (dataset/sequence/frame) of a listing: of the first adapter that has it, there the first by path.

    An empty listing gives no rows; repeated paths count once.
    """
    both = archived_pairs(files).withColumn("adapter", F.lit(0)).unionByName(sibling_pairs(files, root_name).withColumn("adapter", F.lit(1)))
    named = both.withColumn("sample_id", F.concat_ws("/", "dataset_name", "sequence_name", "frame_id"))
    first = F.struct("adapter", "place", *(c for c in _SAMPLE))
    return _spread(named, "sample_id").groupBy("sample_id").agg(F.min(first).alias("s")).select("sample_id", *(f"s.{c}" for c in _SAMPLE), F.get(F.array(*map(F.lit, ADAPTERS)), "s.adapter").alias("adapter"))


class Index:
    """The index at `path`: builds in folders of their own, and `current.json`, which names the one that counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def metadata(self) -> dict | None:
        """What the current build says of itself; None before the first one."""
        where = self._path(f"{self.path}/current.json")
        if not self._files.exists(where):
            return None
        return json.loads(self.spark.read.text(str(where.toString()), wholetext=True).first().value)

    def read(self) -> DataFrame:
        """The samples of the current build; later builds don't change what this reads."""
        if (found := self.metadata()) is None:
            raise FileNotFoundError(f"no index at {self.path}")
        return samples(self.spark, f"{self.path}/{found['build']}")

    def build(self, found: DataFrame, root: str) -> dict:
        """Write the samples, counted while they are written, then make them the current ones; the new metadata."""
        build, seen = f"build-{uuid.uuid4().hex}", Observation()
        found.observe(seen, F.count(F.lit(1)).alias("samples"), *(F.coalesce(F.max(F.col("adapter") == n), F.lit(False)).alias(n) for n in ADAPTERS)).drop("adapter").write.json(f"{self.path}/{build}")
        number = self.spark.read.schema("dataset_name string").json(f"{self.path}/{build}").agg(F.count_distinct("dataset_name")).first()[0]
        meta = {"dataset_root": root, "build": build, "sample_count": seen.get["samples"], "dataset_count": number, "adapter_names": sorted(n for n in ADAPTERS if seen.get[n])}
        self._replace("current.json", json.dumps(meta))
        return meta

    def _replace(self, name: str, text: str) -> None:
        """A small file replaced in one step of the file system."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        beside = self._path(f"{self.path}/_{name}-{uuid.uuid4().hex}")
        out = self._files.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        how = gateway.new_array(fs.Options.Rename, 1)
        how[0] = fs.Options.Rename.OVERWRITE
        final = self._files.makeQualified(self._path(f"{self.path}/{name}"))
        fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._files.makeQualified(beside), final, how)

    def clean(self) -> list[str]:
        """Remove builds that aren't current, those that failed included; for when nothing reads or builds any more."""
        now = (self.metadata() or {}).get("build")
        old = [s.getPath().getName() for s in self._files.listStatus(self._path(self.path)) if s.getPath().getName().startswith("build-")]
        old = sorted(n for n in old if n != now)
        for n in old:
            self._files.delete(self._path(f"{self.path}/{n}"), True)
        return old
