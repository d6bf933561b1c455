import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import cells, serving, training
from tidewater.sources import keyed


@pytest.mark.parametrize(("n", "share"), [(1, 0.2), (2, 0.2), (10, 0.2), (10, 1.0), (1000, 0.25)])
def test_split_takes_the_first_hashes(spark, n, share):
    rows = spark.range(n).withColumnRenamed("id", "g")
    out = {r.g: r.validation for r in training.group_split(rows.unionByName(rows), "g", share).collect()}
    order = [r.g for r in rows.orderBy(training.order_hash(F.col("g"))).collect()]
    wanted = 0 if n < 2 else max(1, min(round(n * share), n - 1))
    assert {g for g, v in out.items() if v} == set(order[:wanted]) and len(out) == n


def test_hard_and_easy(spark):
    rows = spark.createDataFrame([(1, i, int(i == 0), i) for i in range(30)] + [(2, i, 0, i) for i in range(4)], "g long, item long, y int, rank int")
    out = training.hard_and_easy(rows, "g", "y", "rank", 9).groupBy("g", "kind").count().collect()
    assert {(r.g, r.kind): r["count"] for r in out} == {(1, "positive"): 1, (1, "hard"): 3, (1, "easy"): 6, (2, "hard"): 4}


def test_cells_find_the_nearest(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(400, 8))
    odd = [(1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8)]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)] + odd, "vec_id long, v array<double>")
    index = cells.built(v, 8)
    assert index.rows.count() == 400
    q = v.where("vec_id < 10").toDF("query_id", "q")

    def found(probes):
        out = {}
        for r in cells.searched(index, q, 5, probes).collect():
            out.setdefault(r.query_id, set()).add(r.vec_id)
        return out

    exact = {i: set(np.argsort(-np.where(np.arange(400) == i, -np.inf, data @ data[i]))[:5].tolist()) for i in range(10)}
    assert found(8) == exact
    some = found(4)
    assert sum(len(some[i] & exact[i]) for i in range(10)) >= 40


def test_cells_of_no_vectors(spark):
    v = spark.createDataFrame([], "vec_id long, v array<double>")
    assert cells.searched(cells.built(v), v.toDF("query_id", "q"), 5, 2).count() == 0


def test_feed_excludes_and_pages(spark):
    ranked = spark.createDataFrame([(1, 7, i, 1.0 - i / 10) for i in range(6)], "request long, user long, item long, score double")
    seen = spark.createDataFrame([(7, 0)], "user long, item long")
    items = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "item long, title string")
    gone = spark.createDataFrame([(1, 2)], "request long, item long")
    pages = [[(r.item, r.title) for r in serving.feed(ranked, seen, items, p, 2, gone).orderBy("place").collect()] for p in (1, 2, 3)]
    assert pages == [[(1, "t1"), (3, "t3")], [(4, "t4"), (5, None)], [(0, "t0")]]


def test_key_value_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', [1, 2], None), (None, "x", [3], 1.5), (2, None, None, 2.0)], "id long, name string, list array<int>, x double")
    out = {(r.key, r.field): r.value for r in keyed.fields(df, "id", "user").collect()}
    assert out == {("user:1", "name"): '"a\\"b"', ("user:1", "list"): "[1,2]", ("user:2", "x"): "2.0"}

    folder = str(tmp_path)

    def connect():
        import os
        import uuid

        path = os.path.join(folder, uuid.uuid4().hex)

        def write(rows):
            with open(path, "a") as f:
                f.writelines("\t".join(r) + "\n" for r in rows)

        return write

    keyed.put(keyed.fields(df, "id", "user"), connect, 1)
    assert sorted(line for p in tmp_path.iterdir() for line in p.read_text().splitlines()) == sorted("\t".join((*k, v)) for k, v in out.items())
