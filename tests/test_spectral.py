"""Spectra from moving sums against the transform of each window."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrilith.functions import kernels
from metrilith.operators import spectral


@pytest.mark.parametrize("part", [70, 4096])
def test_windows_of_series_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(spectral, "PART", part)
    rng = random.Random(6)
    series = {p: [10_000 + 0.3 * i + 20 * np.sin(2 * np.pi * i / (5 + p)) + rng.gauss(0, 3) for i in range(n)] for p, n in ((0, 300), (1, 64), (2, 63), (3, 16), (4, 15), (5, 129))}
    rows = [(p, 3 * i, float(x)) for p, v in series.items() for i, x in enumerate(v)] + [(0, 1, None), (5, 2, float("nan"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "p int, frame bigint, x double")
    got = {(r.p, r.frame): r for r in spectral.dominant(df, ["p"], "frame", "x", 30.0).collect()}
    assert set(got) == {(p, 3 * i) for p, v in series.items() for i in range(15, len(v))}
    for (p, frame), r in got.items():
        i = frame // 3
        want = kernels.dominant(np.array(series[p][max(0, i - 63) : i + 1]), 30.0)
        assert r.i == i and np.allclose([r.frequency, r.amplitude, r.energy], want, rtol=1e-6), (p, i, r, want)


def test_consensus_of_a_frame(spark):
    rows = [(p, i, float(np.sin(2 * np.pi * i / (8 if p < 3 else 4)))) for p in range(4) for i in range(70)]
    found = spectral.dominant(spark.createDataFrame(rows, "p int, frame bigint, x double"), ["p"], "frame", "x", 30.0)
    last = spectral.consensus(found, "frame", 30.0).filter("frame = 69").select("p", "frequency", "consensus", "agreement").collect()
    assert all(r.consensus == 3.75 and (r.agreement == 1.0) == (r.p < 3) for r in last) and len(last) == 4
    assert spectral.consensus(found.filter(F.lit(False)), "frame", 30.0).count() == 0


def test_windows_go_on_over_batches_and_need_no_moving_sums(spark):
    rng = random.Random(3)
    series = {p: [rng.gauss(0, 3) for _ in range(n)] for p, n in ((0, 200), (1, 90), (2, 20))}
    df = spark.createDataFrame([(p, i, x) for p, v in series.items() for i, x in enumerate(v)], "p int, frame int, x double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = spectral.dominant(df, ["p"], "frame", "x", 30.0)
        got = {(r.p, r.frame): [r.frequency, r.amplitude, r.energy] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(p, i): kernels.dominant(np.array(v[max(0, i - 63) : i + 1]), 30.0) for p, v in series.items() for i in range(15, len(v))}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-6) for k in want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "COS(" not in plan.upper()
