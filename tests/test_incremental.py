"""Runs that are stopped and repeated: each key's rows are in the output once."""

import pytest
from pyspark.sql import functions as F

from regionfx.plans import models
from regionfx.streaming import incremental


class Stopped(Exception):
    pass


def _out(spark, path):
    return sorted((tuple(r) for r in incremental.read_finished(spark, path).collect()), key=str)


def test_null_keys_are_scored_once(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, 2.0), (None, 4.0), (None, 6.0), (2, 5.0)], "k long, v double")
    score = incremental.by_key_mean("k", "v")
    assert incremental.incremental_scoring(df.where("k = 1"), "k", score, path) == 1
    assert incremental.incremental_scoring(df, "k", score, path) == 2
    assert incremental.incremental_scoring(df, "k", score, path) == 0
    assert _out(spark, path) == sorted([(1, 2.0), (2, 5.0), (None, 5.0)], key=str)


@pytest.mark.parametrize("where", ["score", "manifest"])
def test_stopped_half_way(spark, tmp_path, monkeypatch, where):
    path = str(tmp_path / "out")
    df = spark.range(40).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit(1.5).alias("v")).union(spark.range(1, 40).select("id", F.lit(2.5)))
    calls = []

    def score(rows):
        calls.append(1)
        if where == "score" and len(calls) == 3:
            raise Stopped
        return incremental.by_key_mean("k", "v")(rows).where("k IS NULL OR k <> 7")  # a key may have no result

    own = incremental.write_batch
    if where == "manifest":

        def cut(spark, path, batch, rows, keys, partition_by=None):
            if batch.endswith("2"):
                rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")  # and nothing after
                raise Stopped
            own(spark, path, batch, rows, keys, partition_by)

        monkeypatch.setattr(incremental, "write_batch", cut)
    with pytest.raises(Stopped):
        incremental.incremental_scoring(df, "k", score, path, keys_per_batch=10)
    monkeypatch.setattr(incremental, "write_batch", own)
    assert len(_out(spark, path)) in (19, 20)
    done = incremental.finished_keys(spark, path, "k").count()
    assert done == 20 and incremental.incremental_scoring(df, "k", score, path, keys_per_batch=10) == 20
    want = [(k, 2.0) for k in range(1, 40) if k != 7] + [(None, 1.5)]
    assert _out(spark, path) == sorted(want, key=str)
    assert incremental.incremental_scoring(df, "k", score, path, keys_per_batch=10) == 0


def test_repeated_stream_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k long, score double")
    for rows in (df, df):
        incremental.write_batch(spark, path, "stream-000000000000", rows, rows.select("k"))
    assert _out(spark, path) == [(1, 2.0), (2, 3.0)]
    again = df.union(spark.createDataFrame([(None, 9.0)], df.schema))
    assert incremental.incremental_scoring(again, "k", lambda x: x, path) == 1
    assert _out(spark, path) == sorted([(1, 2.0), (2, 3.0), (None, 9.0)], key=str)


def test_saturation_by_region(spark, tmp_path):
    path = str(tmp_path / "out")
    train = spark.range(60).select((F.col("id") % 7).cast("double").alias("Res_MD_1"), (F.col("id") % 7 > 3).cast("double").alias("label"))
    model = models.train_classifier(train, ["Res_MD_1"], "label", trees=3, depth=3)
    rows = spark.createDataFrame([(r, p, "ANR"[p % 3]) for r in ("a", "b", "c", None) for p in range(5)], "region string, pos int, letter string")
    add = lambda x: x.withColumn("Res_MD_1", F.ascii("changed") % 7 + F.lit(0.0))
    run = lambda df: models.saturation_by_region(df, "region", "letter", list("ANR"), add, {"p": model}, path, ["region", "pos", "letter", "changed", "p"], regions_per_batch=2)
    assert run(rows.where("region = 'b'")) == 1 and run(rows) == 3 and run(rows) == 0
    got = incremental.read_finished(spark, path)
    assert got.count() == 40 and got.distinct().count() == 40 and got.where("region is null").count() == 10
    assert {f.split("/batch=")[1].split("/")[1] for f in got.inputFiles() if "/rows/" in f} == {"region=a", "region=b", "region=c", "region=__HIVE_DEFAULT_PARTITION__"}
    assert got.where("p < 0 or p > 1 or letter = changed").isEmpty()
