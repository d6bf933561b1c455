"""Offline ranking metrics. Ties of score go by item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import cumulated, valid_groups


def _placed(rows: DataFrame, group: str, score: str) -> DataFrame:
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), "item")))


def ndcg(rows: DataFrame, group: str, score: str, label: str, k: int) -> DataFrame:
    """One row for each valid group."""
    fine = _placed(valid_groups(rows, group, label), group, score).withColumn("_best", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(label), "item")))
    gain = F.pow(2.0, F.col(label)) - 1
    sums = fine.groupBy(group).agg(
        F.sum(F.when(F.col("_at") <= k, gain / F.log2(F.col("_at") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("_best") <= k, gain / F.log2(F.col("_best") + 1.0)).otherwise(0.0)).alias("ideal"),
    )
    return sums.select(group, (F.col("dcg") / (F.col("ideal") + 1e-9)).alias("ndcg"))


def auc(rows: DataFrame, score: str, label: str, group: str | None = None) -> DataFrame:
    """Rank-sum AUC with mid-ranks for ties; 0.5 where one class is missing. For a group each, or for all rows; scores are counted first."""
    keys = [group] if group else []
    counts = rows.groupBy(*keys, score).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) > 0, 0).otherwise(1)).alias("n"))
    wins = cumulated(counts, score, ["n"], keys).withColumn("w", F.col("p") * (F.col("n_before") + F.col("n") / 2))
    out = wins.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    return out.select(*keys, (F.col("p") + F.col("n")).alias("n_rows"), F.col("p").alias("n_positive"), F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).otherwise(0.5).alias("auc"))


def gauc(rows: DataFrame, user: str, score: str, label: str) -> DataFrame:
    """AUC of the users of both classes, weighted by their rows."""
    each = auc(rows, score, label, user).where("n_positive > 0 and n_positive < n_rows")
    return each.agg((F.sum(F.col("auc") * F.col("n_rows")) / F.sum("n_rows")).alias("gauc"), F.count("*").alias("n_users"))


def hits(rows: DataFrame, group: str, score: str, label: str, k: int) -> DataFrame:
    """Of each group with positives: recall, precision, hit, reciprocal rank and average precision (over the positives among the first k) at k."""
    placed = _placed(rows, group, score).withColumn("_y", (F.col(label) > 0).cast("int"))
    run = Window.partitionBy(group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_sum", F.sum("_y").over(run))
    top = F.when(F.col("_at") <= k, F.col("_y")).otherwise(0)
    out = placed.groupBy(group).agg(
        F.sum("_y").alias("n_positive"), F.sum(top).alias("n_hit"), F.min(F.when((F.col("_y") == 1) & (F.col("_at") <= k), F.col("_at"))).alias("first_hit"),
        F.sum(F.when(top == 1, F.col("_sum") / F.col("_at")).otherwise(0.0)).alias("precisions"),
    ).where("n_positive > 0")
    return out.select(
        group, "first_hit", (F.col("n_hit") / F.col("n_positive")).alias("recall"), (F.col("n_hit") / k).alias("precision"),
        F.when(F.col("n_hit") > 0, 1).otherwise(0).alias("hit"), F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal"),
        F.when(F.col("n_hit") > 0, F.col("precisions") / F.col("n_hit")).alias("average_precision"),
    )
