"""Calibration files of all forms give one table; broken ones are named."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrilith.plans import reports
from metrilith.sources import calibration

K = [[500.0, 0.0, 320.0], [0.0, 510.0, 240.0], [0.0, 0.0, 1.0]]
R = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
T = [-60.0, 0.0, 25.0]
GOOD = {"name": "a", "image_size": [640, 480], "K_left": K, "K_right": K, "T": T, "R": R}


def xml(parts):
    cell = lambda m: f'<rows>{len(m)}</rows><cols>{len(m[0])}</cols><dt>d</dt><data>\n {" ".join(map(repr, sum(m, [])))}</data>'
    body = "".join(f'<{k} type_id="opencv-matrix">{cell(v)}</{k}>' if isinstance(v, list) else f"<{k}>{v}</{k}>" for k, v in parts.items())
    return f'<?xml version="1.0"?>\n<opencv_storage>\n{body}</opencv_storage>\n'


def read(spark, folder):
    return {os.path.basename(r.path): r for r in calibration.calibrations(spark, str(folder)).collect()}


def test_forms_agree(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GOOD, indent=2))
    long = {"name": "a", "imageSize": [[640], [480]], "left_camera_matrix": K, "right_camera_matrix": K, "translation": [[x] for x in T], "rotation": R, "comment": {"by": 1}}
    (tmp_path / "b.json").write_text(json.dumps(long))
    (tmp_path / "c.xml").write_text(xml({"name": "a", "image_size": [[640, 480]], "K_left": K, "K_right": K, "R": R, "T": [[x] for x in T]}))
    np.savez(tmp_path / "d.npz", **{k: np.array(v) for k, v in GOOD.items()})
    got = read(spark, tmp_path)
    want = np.array(K) @ np.column_stack((R, T))
    assert set(got) == {"a.json", "b.json", "c.xml", "d.npz"}
    for r in got.values():
        assert r.issues == [] and r.name == "a" and r.unit == "mm" and r.image_size == [640, 480] and r.K_left == K and r["T"] == T and r.D_left == [0.0] * 5 and r.Q is None
        assert np.allclose(r.P2, want) and np.allclose(r.P1, np.array(K) @ np.eye(3, 4)) and r.baseline == 65.0


def test_yaml(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(GOOD))
    (tmp_path / "b.yml").write_text("- 1\n- 2\n")
    (tmp_path / "c.yaml").write_text("a: [1\n")
    got = read(spark, tmp_path)
    assert got["a.yaml"].issues == [] and got["a.yaml"].K_right == K and got["b.yml"].issues == ["file"] and got["c.yaml"].issues == ["file"]


def test_broken_files(spark, tmp_path):
    cases = {
        "unit": {**GOOD, "unit": "m"}, "image_size": {**GOOD, "image_size": [640, 0]}, "R": {**GOOD, "R": None, "P2": [[1, 0, 0, 0]] * 3}, "P1": {**GOOD, "P1": K}, "Q": {**GOOD, "Q": [[1, 2], [3, 4]]},
        # a preferred name wins over its alias though its value is no good
        "K_left": {**GOOD, "K_left": "none", "left_camera_matrix": K, "P1": [[1, 0, 0, 0]] * 3},
    }
    for n, doc in cases.items():
        (tmp_path / f"{n}.json").write_text(json.dumps(doc))
    (tmp_path / "many.json").write_text("{}")
    (tmp_path / "text.json").write_text("{broken")
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "short.xml").write_text(xml({"image_size": [[640, 480]], "K_left": K, "K_right": K, "T": [T]}).replace("<rows>3</rows>", "<rows>4</rows>", 1))
    (tmp_path / "notes.txt").write_text("no calibration")
    got = {k: r.issues for k, r in read(spark, tmp_path).items()}
    assert {k: v for k, v in got.items() if k.split(".")[0] in cases} == {f"{k}.json": [k] for k in cases}
    assert got["many.json"] == ["image_size", "K_left", "K_right", "P1", "P2", "T"] and got["short.xml"] == ["K_left", "P1"]
    assert got["text.json"] == got["list.json"] == ["file"] and "notes.txt" not in got and got.get("empty.json", ["file"]) == ["file"]


def test_round_trip(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    (tmp_path / "in" / "a.json").write_text(json.dumps({**GOOD, "Q": np.eye(4).tolist()}))
    first = calibration.calibrations(spark, str(tmp_path / "in"))
    os.mkdir(tmp_path / "out")
    for r in calibration.as_json(first).collect():
        (tmp_path / "out" / f"{r.name}.json").write_text(r.text)
    assert first.drop("path").collect() == calibration.calibrations(spark, str(tmp_path / "out")).drop("path").collect()
    os.mkdir(tmp_path / "none")
    assert calibration.calibrations(spark, str(tmp_path / "none")).count() == 0


def test_lines_of_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(GOOD), "", json.dumps({**GOOD, "name": "b", "unit": "m"}), "{broken"]) + "\n")
    os.mkdir(tmp_path / "parts.jsonl")
    for k in range(3):
        (tmp_path / "parts.jsonl" / f"part-{k}.json").write_text("".join(json.dumps({**GOOD, "name": f"{k}{i}"}) + "\n" for i in range(2)))
    (tmp_path / "part-0.txt").write_text("no calibration")
    (tmp_path / "single.json").write_text(json.dumps({**GOOD, "name": "single"}, indent=2))
    got = sorted((os.path.relpath(r.path.removeprefix("file:"), tmp_path).replace("../", ""), r.name, tuple(r.issues)) for r in calibration.calibrations(spark, str(tmp_path)).collect())
    want = [("a.jsonl", "a", ()), ("a.jsonl", "b", ("unit",)), ("a.jsonl", "stereo_camera", ("file",)), ("single.json", "single", ())]
    assert got == sorted(want + [(f"parts.jsonl/part-{k}.json", f"{k}{i}", ()) for k in range(3) for i in range(2)])


def test_files_do_not_grow_with_calibrations(spark, tmp_path, monkeypatch):
    """The driver lists every file, so that no calibration has one of its own."""
    out, n = str(tmp_path / "out"), 600
    monkeypatch.setattr(reports, "folder", lambda spark, label: out)
    df = spark.range(1, n + 1).select(F.col("id").alias("s_suppkey"), (F.col("id") * 1.25).alias("s_acctbal"))
    df.write.parquet(f"{tmp_path}/supplier.parquet")
    assert reports.src15(spark, str(tmp_path)).count() == sum(k % 3 != 2 or k % 11 != 0 for k in range(1, n + 1))
    assert sum(f.startswith("part-") for _, _, files in os.walk(out) for f in files) <= 4 * 64
