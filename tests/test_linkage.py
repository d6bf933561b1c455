import datetime
import time

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.operators import recall, serving
from tidewater.streaming import behaviour


def test_measures(spark):
    rows = spark.createDataFrame([("跑5 公里",), ("3.5千克 2升",), ("10毫升 7ml",), ("9 米",)], "t string")
    assert [r[0] for r in rows.select(text.measures(F.col("t"))).collect()] == ["跑5km", "3.5kg 2l", "10ml 7ml", "9m"]


def test_linkage_boosts(spark):
    rows = spark.createDataFrame([("Red Dress", "a red one", "x"), (None, None, None)], "title string, content string, tag_1 string")
    words, tags = F.array(*map(F.lit, ("red", " DRESS ", "", "hat", "one"))), F.array(F.lit("x"))
    out = [r[0] for r in rows.select(serving.linkage_boosts(rows, words, tags, False)).collect()]
    assert out == [pytest.approx(2 * 0.14 + 0.06 + 0.06), 0.0]


def test_complement_negatives(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "request long, item long")
    recalled = spark.createDataFrame([(1, i, i) for i in range(1, 8)], "request long, item long, rank int")
    assert recall.complement_negatives(recalled, pairs((1, 1)), pairs((1, 3)), 6, 3).first().asDict() == {"request": 1, "items": [2, 4, 5]}


def test_padding_without_known_vectors(spark):
    h = spark.createDataFrame([(1, 5, 0)], "user long, vec_id long, recency int")
    v = spark.createDataFrame([(9, [1.0, 2.0])], "vec_id long, v array<double>")
    assert serving.padded_sequences(h, v, 2, 2).first().asDict() == {"user": 1, "n": 0, "sequence": [[0.0, 0.0], [0.0, 0.0]]}


def test_front_lists_of_a_stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(u, n, 10 * k + u, start + datetime.timedelta(seconds=k)) for k, n in enumerate([1, 2, 3, 1, None, 4]) for u in (1, 2)]
    schema = "user long, note long, event_id long, ts timestamp"
    source = str(tmp_path / "in")
    spark.createDataFrame(rows[:6], schema).coalesce(1).write.parquet(source)
    time.sleep(1.1)
    spark.createDataFrame(rows[6:], schema).coalesce(1).write.mode("append").parquet(source)
    latest = {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def keep(batch, _):
        latest.update({r.user: r.notes for r in batch.collect()})

    run = behaviour.front_lists(stream, 3).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(100)
    expected = {r.user: r.notes for r in behaviour.front_list(spark.createDataFrame(rows, schema), 3).collect()}
    assert latest == expected == {1: [4, 1, 3], 2: [4, 1, 3]}


def test_hard_negatives_look_no_further_than_the_first(spark):
    recalled = spark.createDataFrame([(1, i, i) for i in range(1, 12)], "request long, item long, rank int")
    positives = spark.createDataFrame([(1, i) for i in range(1, 8)], "request long, item long")
    assert recall.hard_negatives(recalled, positives, 2).first().asDict() == {"request": 1, "items": [8]}
    assert recall.hard_negatives(recalled, positives, 2, 10).first().asDict() == {"request": 1, "items": [8, 9]}
