"""CSV files of differing headers against the standard reader, truth without a point, resumed writes."""

import csv
import random

import pytest

from metrilith.operators import align
from metrilith.sources import readers

FILES = {
    "a": 'method,frame,err\r\nA,1,0.5\r\nA,2,\r\n\r\nA,3,1.5,9\r\n',
    "b": '﻿frame,confidence,method\n7,0.9,B\n8,,B\n9\n',
    "c": 'err,"note, long",err\n1,"said ""yes"", twice",2\n,,\n',
    "d": "method,err\n",
    "e": "",
    "same": "err,method\n5,B\n6,other\n",
    "summary": "method,err\nS,9\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8", newline="")
    return tmp_path


def plain(path):
    with path.open(newline="", encoding="utf-8-sig") as f:
        return [{k: v for k, v in row.items() if k is not None and v is not None} for row in csv.DictReader(f)]


def test_rows_of_each_file_by_its_own_header(spark, folder):
    got = {}
    for r in readers.csv_rows(spark, f"{folder}/*.csv").collect():
        got.setdefault(r.file.rsplit("/", 1)[1][:-4], []).append(dict(r.cells))
    want = {name: rows for name in FILES if (rows := plain(folder / f"{name}.csv"))}
    assert set(got) == set(want)
    for name, rows in want.items():
        assert sorted(map(str, map(lambda x: sorted(x.items()), rows))) == sorted(map(str, map(lambda x: sorted(x.items()), got[name]))), name


def test_methods_of_files(spark, folder):
    t = readers.method_tables(spark, str(folder))
    assert t.columns == ["file", "method", "err", "frame", "note, long"]  # b.csv, with its confidence, gives way to same.csv
    got = {(r.file, r.method, r.err, r.frame) for r in t.collect()}
    # the later file of one method counts, by its first row; a file without a method column has its name
    assert got == {("a", "A", "0.5", "1"), ("a", "A", None, "2"), ("a", "A", "1.5", "3"), ("same", "B", "5", None), ("same", "B", "6", None), ("c", "c", "2", None), ("c", "c", None, None)}


def test_split_files_and_broken_quotes(spark, tmp_path):
    rows = [{"i": str(k), "v": "x" * (k % 50)} for k in range(20_000)]
    with (tmp_path / "long.csv").open("w", newline="") as f:
        w = csv.DictWriter(f, ["i", "v"])
        w.writeheader()
        w.writerows(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        t = readers.method_tables(spark, str(tmp_path))
        assert t.rdd.getNumPartitions() > 5
        assert sorted((int(r.i), r.v or "") for r in t.collect()) == [(int(r["i"]), r["v"]) for r in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "broken.csv").write_text('a,b\n1,"two\nlines"\n')
    with pytest.raises(Exception, match="over the line's end"):
        readers.csv_rows(spark, f"{tmp_path}/broken.csv").collect()


def test_a_line_is_split_once(spark, folder):
    """Neither what is asked of cells nor the table's name, which its path tells, is worked out anew for each line."""
    t = readers.method_tables(spark, str(folder)).filter("try_cast(err as double) > 1 or frame is null")
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "regexp_extract(" not in plan
    assert {(r.file, r.err) for r in t.collect()} == {("a", "1.5"), ("same", "5"), ("same", "6"), ("c", "2"), ("c", None)}


def test_long_quoted_cells_and_headers_side_by_side(spark, tmp_path):
    long = 'a"b,' * 20_000
    with (tmp_path / "long.csv").open("w", newline="") as f:
        csv.writer(f).writerows([["v", "w"], [long, "1"], ["x", "2"]])
    # files of one partition: the line after a lone header belongs to the next file
    for k in range(6):
        (tmp_path / f"z{k}.csv").write_text("\nv,method\n" + (f"{k},m{k}\n" if k % 2 else ""))
    got = readers.method_tables(spark, str(tmp_path)).collect()
    assert {(r.file, r.method, r.v, r.w) for r in got} == {("long", "long", long, "1"), ("long", "long", "x", "2")} | {(f"z{k}", f"m{k}", str(k), None) for k in (1, 3, 5)}


def brute_truth(left, right, pick):
    out = {}
    for i, point, at in left:
        fits = [(o, v, t) for o, p, t, v in right if p in (None, "", "  ") or (p == point and point not in (None, ""))]
        out[i] = pick(at, fits)
    return out


@pytest.fixture(scope="module")
def series():
    rng = random.Random(5)
    points = ["a", "b", None, ""]
    left = [(i, rng.choice(points), float(rng.randrange(60))) for i in range(300)] + [(300, "a", None)]
    right = [(o, rng.choice([*points, "  "]), float(rng.randrange(0, 240)) / 4, f"v{o}") for o in range(120)] + [(120, "a", None, "none")]
    return left, right


@pytest.mark.parametrize("crowd", [3, 250_000])
def test_nearest_truth_of_the_point_or_of_any(spark, series, monkeypatch, crowd):
    monkeypatch.setattr(align, "CROWD", crowd)
    left, right = series

    def pick(at, fits):
        near = min(((abs(t - at), o, v) for o, v, t in fits if t is not None and at is not None), default=None)
        return near[2] if near and near[0] <= 1.5 else None

    a = spark.createDataFrame(left, "i int, point string, t double")
    b = spark.createDataFrame(right, "o int, point string, t double, v string")
    got = {r.i: r.v for r in align.nearest_truth(a, b, "point", "t", 1.5, "i", "o", ["v"]).collect()}
    assert got == brute_truth(left, right, pick)
    assert align.nearest_truth(a, b.limit(0), "point", "t", 1.5, "i", "o", ["v"]).filter("v is not null").isEmpty()


def test_truth_of_a_frame(spark, series):
    left, right = ([(x[0], x[1], None if x[2] is None else int(x[2])) for x in series[0]], [(x[0], x[1], None if x[2] is None else int(x[2]), x[3]) for x in series[1]])

    def pick(at, fits):
        same = min(((o, v) for o, v, t in fits if t is not None and t == at), default=None)
        return same and same[1]

    a = spark.createDataFrame(left, "i int, point string, frame int")
    b = spark.createDataFrame(right, "o int, point string, frame int, v string")
    got = {r.i: r.v for r in align.truth_of_frame(a, b, "point", "frame", "o", ["v"]).collect()}
    assert got == brute_truth(left, right, pick)


def test_resumed_write_of_null_and_repeated_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, "e")], "id int, v string")
    assert readers.write_remaining(rows, f"{tmp_path}/t", "id") == 3
    assert readers.write_remaining(rows, f"{tmp_path}/t", "id") == 0
    assert sorted(str(r.id) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == ["1", "2", "None"]
