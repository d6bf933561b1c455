import datetime as dt

from pyspark.sql import functions as F

from tidewater.streaming.behaviour import accepted, gap_deduplicated


def events(spark, seconds):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, "rec", "click", 5, 9, i, start + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "user long, scene string, action string, note long, request long, event_id long, ts timestamp")


def test_stream_accepts_what_comes_two_seconds_after_the_last_accepted(spark, tmp_path):
    data = events(spark, [0, 1, 1.5, 2.5, 6, 6.5])
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = accepted(stream, 2).writeStream.format("memory").queryName("taken").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert sorted(r.event_id for r in spark.sql("select event_id from taken").collect()) == [0, 3, 4]
    finally:
        q.stop()


def test_gap(spark):
    assert sorted(r.event_id for r in gap_deduplicated(events(spark, [0, 1, 4, 9]), 2).select("event_id").collect()) == [0, 2, 3]
    assert gap_deduplicated(events(spark, [0]).where(F.lit(False)), 2).count() == 0
