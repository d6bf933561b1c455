"""Filters, joins, ranks and set operations over requests, users and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_groups(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Rows of groups of more than one row with a positive label."""
    w = Window.partitionBy(group)
    return rows.withColumns({"_n": F.count("*").over(w), "_m": F.max(label).over(w)}).where("_n > 1 and _m > 0").drop("_n", "_m")


def top_k(rows: DataFrame, group: str | list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    keys = [group] if isinstance(group, str) else group
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return top_k(rows, key, order, 1, "_latest").drop("_latest")


def z_score(group: str, value: str, epsilon: float = 1e-9) -> Column:
    """By the sample deviation of the group; 0 in groups of one row or of equal values."""
    w = Window.partitionBy(group)
    sd = F.stddev_samp(value).over(w)
    return F.when((F.count("*").over(w) <= 1) | (F.coalesce(sd, F.lit(0.0)) == 0), 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / (sd + epsilon))


def min_max(group: str | list[str], value: str, degenerate: float, epsilon: float = 0.0) -> Column:
    """To [0, 1] within the group; degenerate where all values are equal."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group))
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, F.lit(degenerate)).otherwise((F.col(value) - low) / (high - low + epsilon))


def cumulated(counts: DataFrame, order: str, sums: list[str], groups: list[str] = (), parts: int = 256) -> DataFrame:
    """counts, one row for each value of order (in each group), with <c>_before: the sum of c over the smaller values. Without groups, values are cut to about parts
    ranges, ranges are summed first, and then each within itself, so no task goes through all values."""
    below = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if groups:
        w = below(Window.partitionBy(*groups).orderBy(order))
        return counts.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums})
    at = [i / parts for i in range(1, parts)]
    edges = counts.agg(F.array_distinct(F.percentile_approx(order, at, 10_000)).alias("_edges"))
    cut = counts.crossJoin(F.broadcast(edges)).withColumn("_part", F.size(F.filter(F.coalesce("_edges", F.array()), lambda e: e < F.col(order)))).drop("_edges")
    ranges = cut.groupBy("_part").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    starts = ranges.select("_part", *(F.coalesce(F.sum(f"_{c}").over(below(Window.orderBy("_part"))), F.lit(0)).alias(f"_{c}") for c in sums))
    w = below(Window.partitionBy("_part").orderBy(order))
    return cut.join(starts, "_part").withColumns({f"{c}_before": F.col(f"_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums}).drop("_part", *(f"_{c}" for c in sums))


def quantiles(rows: DataFrame, value: str, shares: list[float], name: str = "quantiles") -> DataFrame:
    """One row: the exact quantiles of value, as an array, interpolated between neighbours; null without values. Values are counted first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    placed = cumulated(counts, "_v", ["_n"]).crossJoin(F.broadcast(total))
    held = lambda at: (at >= F.col("_n_before")) & (at < F.col("_n_before") + F.col("_n"))
    ends = []
    for q in shares:
        at = F.lit(q) * (F.col("_all") - 1)
        low, high = F.max(F.when(held(F.floor(at)), F.col("_v"))), F.max(F.when(held(F.ceil(at)), F.col("_v")))
        part = F.max(at - F.floor(at))
        ends.append(low + (high - low) * part)
    return placed.agg(F.array(*ends).alias(name))


def standardised(rows: DataFrame, counters: list[str], others: list[str] = ()) -> DataFrame:
    """ln(1 + x) of counters, then these and the others less their mean, over the sample deviation of all rows (1 where it is 1e-6 or less)."""
    logged = rows.withColumns({c: F.log1p(F.col(c).cast("double")) for c in counters})
    columns = [*counters, *others]
    stats = logged.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    out = logged.crossJoin(F.broadcast(stats))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 1e-6, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return out.withColumns(scaled).drop(*stats.columns)


def cold_start(users: DataFrame, requests: DataFrame, least: int = 3) -> DataFrame:
    """user and n of the users with fewer than least requests, those without any included."""
    counts = requests.groupBy("user").agg(F.count("*").alias("n"))
    return users.select("user").distinct().join(counts, "user", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < least)


def without(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(other.select(*keys).distinct(), keys, "left_anti")


def completed(scored: DataFrame, labelled: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The best score of each pair with its labels, and labelled pairs never scored with a null score."""
    best = scored.groupBy(*keys).agg(F.max(score).alias(score))
    return best.join(labelled, keys, "full")


def pessimistic(rows: DataFrame, group: str, score: str, label: str) -> Column:
    """The score; where there is none, below all of the group's: positives lower than negatives."""
    w = Window.partitionBy(group)
    place = F.row_number().over(Window.partitionBy(group, F.col(score).isNull(), F.col(label) > 0).orderBy("item")) - 1
    floor = F.coalesce(F.min(score).over(w), F.lit(0.0))
    return F.coalesce(F.col(score), floor - F.when(F.col(label) > 0, 2.0).otherwise(1.0) - place / 1000)
