"""From raw documents to packed training sequences, in five stages. Each is one operator of tidewater.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.near_duplicates import representatives
from tidewater.llm.packing import packed
from tidewater.llm.quality_rules import accepted
from tidewater.llm.secrets import redact
from tidewater.llm.shared import made_tables, removed, table, written
from tidewater.llm.source_mix import mixture


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list accepts."""
    return accepted(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and n_chars counted anew."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the target weights of their sources take them."""
    return mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of each document stand in which training sequence."""
    return packed(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("secret scan", secret_scan),
    ("source mix", mix),
    ("best-fit packing", pack),
]

#: The learned rules, the similarity join and the tokenizer have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences. What a stage wrote for itself, and its predecessor's result, go when its own result is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, function in STAGES[:-1]:
        with made_tables() as made:
            done = function(spark, docs, sf_dir)
        docs = written(done, f"stage-{name.replace(' ', '-')}")
        removed(spark, [*made, *before])
        before = {f.rsplit("/", 1)[0] for f in docs.inputFiles()}
    return STAGES[-1][1](spark, docs, sf_dir)
