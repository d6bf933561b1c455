import corpus_pipeline
import pytest

from tidewater.llm import near_duplicates, packing, quality_rules, secrets, source_mix
from tidewater.llm.shared import written

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        done = stage(spark, out[-1], DIR).toPandas()
        out.append(spark.createDataFrame(done, docs.schema) if list(done.columns) == docs.columns else done)
    return out


def test_every_stage_does_what_its_operator_decides(spark, stages):
    docs, good, single, clean, mixed, packed = stages
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(good) == ids(quality_rules.quality_rules(docs, labels)[0].where("kept"))
    assert ids(single) == ids(near_duplicates.near_duplicates(good).where("kept"))
    before, after = ({r.doc_id: r for r in x.collect()} for x in (single, clean))
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.text == secrets.redacted(before[i].text, secrets.find_spans(before[i].text)[1]) and r.n_chars == (len(r.text) if r.text != before[i].text else r.n_chars)
    times = {r.doc_id: r.n_copies for r in source_mix.source_mix(clean).collect()}
    assert ids(mixed) == sorted(i for i, n in times.items() for _ in range(n))
    again = packing.packed(mixed).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert packed[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_run_gives_the_same_pieces(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).select(key).collect())) == sorted(map(tuple, stages[-1][key].values.tolist()))


def test_empty_and_null_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for rows in ([], [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0)]):
        now = spark.createDataFrame(rows, docs.schema)
        for _, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, DIR), "stage")
        assert now.count() == 0
