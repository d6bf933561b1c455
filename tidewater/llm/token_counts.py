"""Token counts: an exact histogram of encoded lengths, with prefix and suffix sums.

Documents are counted by length; of the histogram, whose size is that of the longest document at most,
each length gets the documents and tokens up to it and above it, by sums over buckets of lengths and
then within each bucket. So totals, quantiles and totals truncated at any context limit are look-ups.

Defined cases: null and empty texts have length 0 and count as documents; repeated rows count each; an
empty table gives an empty histogram, totals of 0 and null quantiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written
from .tokens import encoder, public_vocabulary

BUCKET = 1024


def lengths(docs: DataFrame, vocabulary=None) -> DataFrame:
    """n_tokens of every row of docs (text)."""
    how = vocabulary or public_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(*how)
        for batch in batches:
            yield pd.DataFrame({"n_tokens": [len(enc.ids(t)) for t in batch["text"]]}, dtype="int64")

    return docs.select("text").mapInPandas(run, "n_tokens long")


def histogram(counted: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """counted: n_tokens. For each length as context limit: n_docs of that length, documents and tokens up to
    and above it, the tokens left when longer documents are cut to it, and the share of documents up to it."""
    bars = written(counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths").withColumn(
        "bucket", F.floor(F.col("n_tokens") / bucket).cast("long")
    )
    sums = bars.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        "bucket",
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "dt"),
        *(F.sum(c).over(whole).alias(f"{c}_all") for c in "dt"),
    )
    within = Window.partitionBy("bucket").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    docs = F.col("d_before") + F.sum("n_docs").over(within)
    tokens = F.col("t_before") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(within)
    return (
        bars.join(sums, "bucket")
        .select("n_tokens", "n_docs", "d_all", "t_all", docs.alias("docs_up_to"), tokens.alias("tokens_up_to"))
        .select(
            F.col("n_tokens").alias("context_limit"), "n_docs", "docs_up_to", "tokens_up_to",
            (F.col("d_all") - F.col("docs_up_to")).alias("docs_above"),
            (F.col("t_all") - F.col("tokens_up_to")).alias("tokens_above"),
            (F.col("tokens_up_to") + F.col("n_tokens") * (F.col("d_all") - F.col("docs_up_to"))).alias("truncated_total"),
            F.col("t_all").alias("total_tokens"),
            (F.col("docs_up_to") / F.col("d_all")).alias("share_up_to"),
        )
    )


def truncated_total(bars: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut to limit, which need not be a length that occurs: the sums up to the last
    length that is no longer, and limit tokens of each document above it; below the first length, of every document."""
    row = bars.where(F.col("context_limit") <= limit).orderBy(F.desc("context_limit")).select("tokens_up_to", "docs_above").first()
    if row is None:
        row = bars.orderBy("context_limit").select(F.lit(0), F.col("docs_up_to") + F.col("docs_above")).first() or (0, 0)
    return int(row[0] + limit * row[1])


def quantile(bars: DataFrame, q: float) -> int | None:
    """The smallest length up to which the share q of all documents lies."""
    row = bars.where(F.col("share_up_to") >= q).agg(F.min("context_limit")).first()
    return row[0]


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(table(spark, sf_dir, "documents")))
