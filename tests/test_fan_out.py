"""A stream's batches in several outputs: killed between outputs, run again, equal to one batch."""

import pytest

from metrilith.streaming import fan_out


@pytest.fixture
def facts(spark, tmp_path):
    df = spark.range(60).selectExpr("id as frame_id", "id % 7 as point_id", "double(id) as runtime_ms")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def rows(fan, spark, name):
    return sorted(r.frame_id for r in fan.read(spark, name).collect())


def test_killed_between_outputs_and_run_again(spark, facts, tmp_path):
    calls = []

    def fails_once(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return df

    fan = fan_out.FanOut(f"{tmp_path}/out", {"first": fan_out.columns("frame_id"), "second": fails_once, "third": fan_out.columns("frame_id", "runtime_ms")})
    with pytest.raises(Exception, match="killed"):
        fan_out.run(facts, fan, f"{tmp_path}/state")
    # the second batch reached the first output alone
    assert len(rows(fan, spark, "first")) == 40 and len(rows(fan, spark, "second")) == len(rows(fan, spark, "third")) == 20
    fan_out.run(facts, fan, f"{tmp_path}/state")
    assert all(rows(fan, spark, n) == list(range(60)) for n in fan.outputs)
    fan_out.run(facts, fan, f"{tmp_path}/state")
    assert all(rows(fan, spark, n) == list(range(60)) for n in fan.outputs)


def test_a_half_written_batch_is_written_anew(spark, tmp_path):
    fan = fan_out.FanOut(f"{tmp_path}/out", {"only": fan_out.columns("frame_id")})
    batch = spark.range(5).withColumnRenamed("id", "frame_id")
    batch.limit(2).write.parquet(f"{tmp_path}/out/only/_batch-0")
    assert fan(batch, 0) == ["only"] and fan(batch, 0) == []
    assert rows(fan, spark, "only") == [0, 1, 2, 3, 4]


def test_a_batch_of_the_query_has_files_for_many_tasks(spark, small, tmp_path, monkeypatch):
    from metrilith.plans import reports

    monkeypatch.setattr(reports, "folder", lambda spark, label: str(tmp_path))
    assert reports.snk4(spark, small).count() == 7
    assert len(list(tmp_path.glob("in/*.parquet"))) == 64
    assert all(len(list(tmp_path.glob(f"out/{n}/batch=*"))) == 4 for n in fan_out.OUTPUTS)
