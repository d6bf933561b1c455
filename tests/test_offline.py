import json

import pytest
from pyspark.sql import functions as F

from tidewater.operators import training
from tidewater.plans import offline
from tidewater.sources import files

DIR = "/root/testdata/sf0.001"


def test_stages_are_written_once(spark, tmp_path):
    folder = str(tmp_path)
    first = offline.run(spark, DIR, folder, ["prerank", "hard_negatives"])
    n = first["prerank"].count()
    assert n > 0 and set(first) == {"prerank", "hard_negatives"}
    made = sorted(p.name for p in (tmp_path / "prerank").iterdir())
    assert offline.run(spark, DIR, folder, ["prerank"])["prerank"].count() == n
    assert sorted(p.name for p in (tmp_path / "prerank").iterdir()) == made
    (tmp_path / "prerank" / "_SUCCESS").unlink()  # a broken write is replaced
    assert offline.run(spark, DIR, folder, ["prerank"])["prerank"].count() == n
    with pytest.raises(ValueError, match="no such stages"):
        offline.run(spark, DIR, folder, ["nothing"])


def test_published_and_snapshots(spark, tmp_path):
    files.shards(spark.range(10), "id", f"{tmp_path}/a", 3)
    out = files.published(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"}, f"{tmp_path}/out").collect()
    assert {r.name: r.copied for r in out} == {"a": True, "b": False}
    assert spark.read.parquet(f"{tmp_path}/out/a").count() == 10
    files.metric_snapshot(spark.createDataFrame([("x", float("nan")), ("y", None), ("z", 1.5)], "m string, v double").coalesce(1), f"{tmp_path}/m")
    lines = [json.loads(x) for p in (tmp_path / "m").glob("part-*") for x in p.read_text().splitlines()]
    assert lines == [{"m": "x", "v": 0.0}, {"m": "y", "v": 0.0}, {"m": "z", "v": 1.5}]


def test_draws_fall_in_the_right_stretch(spark):
    weights = {3: 1.0, 2000: 2.0, 5000: 0.0, 9000: 7.0}
    items = spark.createDataFrame(list(weights.items()), "item long, w double")
    draws = spark.range(1000).select("id", ((F.col("id") + 0.5) / 1000).alias("x"))
    out = training.drawn(draws, items, 16).collect()
    assert len(out) == 1000
    assert all(r.item == (3 if r.x < 0.1 else 2000 if r.x < 0.3 else 9000) for r in out)


def test_ranker_beats_the_mean(spark):
    rows = spark.range(400).select(F.col("id").alias("request"), F.col("id").alias("item"), *(F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % (i + 2)).alias(c) for i, c in enumerate(offline.FEATURES)))
    rows = rows.withColumn("y", F.coalesce(F.col("position") * 2.0 + F.col("ctr"), F.lit(0.0)))
    out = offline.ranker_scores(rows, rows, "y")
    err, spread = out.agg(F.avg(F.pow(F.col("gbdt") - F.col("y"), F.lit(2.0))), F.var_pop("y")).first()
    assert out.count() == 400 and err < 0.2 * spread
