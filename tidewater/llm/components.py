"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
    return tuple(row)


def _stars(links: DataFrame) -> DataFrame:
    """Large star: every larger neighbour of a node moves to the smallest of its neighbourhood."""
    both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
        links.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
    # a node that is its own minimum keeps its links; others' smaller neighbours are linked with the minimum
    large = large.where("lo <> hi").distinct()
    # Small star: a node and its smaller neighbours move to the smallest of these
    least = large.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = large.join(least, "hi")
    small = joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(joined.select(F.col("m").alias("lo"), "hi"))
    return small.where("lo <> hi").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links: pairs of ids. Returns id and component, the smallest id it can reach, of every id that is linked.

    Null ids and links from an id to itself are left out; no links give no rows. Every step is a grouped
    minimum and an equi-join, written to the shared folder; nothing but a count and a checksum reaches the driver.
    """
    now = written(
        links.where(f"{a} is not null and {b} is not null and {a} <> {b}")
        .select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
        .distinct(),
        "links",
    )
    mark = _mark(now)
    while mark[0]:
        before, now = now, written(_stars(now), "links")
        dropped(before)
        if (new := _mark(now)) == mark:
            break
        mark = new
    roots = now.select(F.col("lo").alias("id")).distinct()
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
