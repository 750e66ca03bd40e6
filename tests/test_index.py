"""The sample index over a folder tree: adapters, first wins, and builds that replace the index as a whole."""

import pytest
from pyspark.sql import functions as F

from metrilith.sources import index

TREE = [
    "FlyingThings3D_subset_image_clean.tar/FlyingThings3D_subset/train/image_clean/left/0001.png",
    "FlyingThings3D_subset_image_clean.tar/FlyingThings3D_subset/train/image_clean/right/0001.png",
    "FlyingThings3D_subset_disparity.tar/FlyingThings3D_subset/train/disparity/left/0001.pfm",
    "FlyingThings3D_subset_image_clean.tar/FlyingThings3D_subset/val/image_clean/left/0.2.png",
    "FlyingThings3D_subset_image_clean.tar/FlyingThings3D_subset/val/image_clean/right/0.2.png",
    "FlyingThings3D_subset_image_clean.tar/FlyingThings3D_subset/val/image_clean/left/alone.png",
    # the same sample_id as the first, by the second adapter
    "FlyingThings3D_subset/train/left/0001.png",
    "FlyingThings3D_subset/train/right/0001.png",
    # left out of the second adapter
    "y_FlyingThings3D_subset_z.tar/s/left/1.png",
    "y_FlyingThings3D_subset_z.tar/s/right/1.png",
    "city/s1/Image_0/deep/a.JPG",
    "city/s1/IMAGE_1/deep/a.JPG",
    "city/s1/image_0/b.png",
    "city/s1/image_1/B.png",
    "city/s2/cam0/left/c.png",
    "city/s2/cam0/right/c.png",
    "city/s2/cam1/left/c.png",
    "city/s2/l/note.txt",
    "city/s2/r/note.txt",
    "left/top.png",
    "right/top.png",
]
WANT = {
    "FlyingThings3D_subset/train/0001": (TREE[0], TREE[1], TREE[2], -1.0, "train"),
    "FlyingThings3D_subset/val/0.2": (TREE[3], TREE[4], None, -1.0, "val"),
    "city/s1/deep/a": ("city/s1/Image_0/deep/a.JPG", "city/s1/IMAGE_1/deep/a.JPG", None, 1.0, None),
    "city/s2/left/c": ("city/s2/cam0/left/c.png", "city/s2/cam1/left/c.png", None, 1.0, None),
    "city/cam0/c": ("city/s2/cam0/left/c.png", "city/s2/cam0/right/c.png", None, 1.0, None),
    "tree/tree/top": ("left/top.png", "right/top.png", None, 1.0, None),
}


def rows(df):
    return {r.sample_id: (r.left_path, r.right_path, r.disparity_gt_path, r.disparity_scale, r.official_split) for r in df.collect()}


def test_tree(spark, tmp_path):
    for f in TREE:
        path = tmp_path / "tree" / f
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    files = index.listing(spark, f"{tmp_path}/tree")
    assert sorted(r.path for r in files.collect()) == sorted(TREE)
    found = index.discovered(files.unionByName(files), "tree")
    assert found.count() == len(WANT) and rows(found) == WANT
    assert index.discovered(files.filter("false"), "tree").count() == 0


def test_builds_replace_each_other(spark, tmp_path):
    files = spark.createDataFrame([(f,) for f in TREE], "path string")
    found = index.discovered(files, "tree")
    at = index.Index(spark, f"{tmp_path}/index")
    with pytest.raises(FileNotFoundError):
        at.read()
    first = at.build(found.filter("adapter = 'generic'"), "tree")
    assert (first["sample_count"], first["dataset_count"], first["adapter_names"]) == (4, 2, ["generic"])
    old = at.read()
    broken = found.withColumn("frame_id", F.when(F.col("sample_id").contains("city"), F.raise_error(F.lit("broken"))).otherwise(F.col("frame_id")))
    with pytest.raises(Exception, match="broken"):
        at.build(broken, "tree")
    assert at.metadata() == first and len(rows(at.read())) == 4
    second = at.build(found, "tree")
    assert second["adapter_names"] == ["FlyingThings3D_subset", "generic"] and second["sample_count"] == 6 and second["dataset_count"] == 3
    assert rows(at.read()) == WANT and len(rows(old)) == 4  # who reads the old build goes on
    assert first["build"] in at.clean() and rows(at.read()) == WANT
    assert at.build(found.filter("false"), "tree")["sample_count"] == 0 and at.read().count() == 0


def test_files_of_one_folder_are_dealt_out_and_partitions_stay_apart(spark):
    """Alike paths shrink when they are shuffled: partitions aren't put together by their size."""
    paths = [f"city/s/{side}/{i}.png" for i in range(300) for side in ("left", "right")]
    found = index.discovered(spark.createDataFrame([(p,) for p in paths], "path string"), "tree")
    assert found.count() == 300
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") >= 9 and "deal" in plan
