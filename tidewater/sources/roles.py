"""The driver's tables in the roles of a search and recommendation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flag(condition) -> Column:
    return F.max(F.when(condition, 1).otherwise(0))


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each request and item, with flags, time on page and position. Rows are dealt by request at once, which serves both the groups and the places."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy(c("l_orderkey").alias("request"), c("l_partkey").alias("item")).agg(
        _flag(c("l_returnflag") != "N").alias("click"), _flag(c("l_returnflag") == "A").alias("like"),
        _flag(c("l_linestatus") == "O").alias("collect"), _flag(c("l_discount") >= 0.08).alias("comment"),
        _flag(c("l_tax") >= 0.07).alias("share"), F.max("l_quantity").alias("page_time"), F.max("l_extendedprice").alias("price"),
    )
    place = Window.partitionBy("request").orderBy(F.desc("price"), "item")
    return rows.withColumn("position", F.row_number().over(place))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("kind")
    )


def behaviours(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene = F.when(F.col("event_id") % 2 == 0, "search").otherwise("rec")
    note = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("user"), scene.alias("scene"), F.col("event_type").alias("action"), note.alias("note"), "ts", "value",
        F.floor(F.col("event_id") / 5).cast("long").alias("request"),
    )


#: The same roles as common table expressions for DuckDB.
IMP = """imp0 as (select l_orderkey as request, l_partkey as item,
  max(case when l_returnflag <> 'N' then 1 else 0 end) as click, max(case when l_returnflag = 'A' then 1 else 0 end) as "like",
  max(case when l_linestatus = 'O' then 1 else 0 end) as collect, max(case when l_discount >= 0.08 then 1 else 0 end) as comment,
  max(case when l_tax >= 0.07 then 1 else 0 end) as share, max(l_quantity) as page_time, max(l_extendedprice) as price
  from lineitem group by all),
imp as (select *, row_number() over (partition by request order by price desc, item) as position from imp0)"""
REQ = "req as (select o_orderkey as request, o_custkey as user_id, o_orderdate as ts, o_orderpriority as kind from orders)"
BEH = """beh as (select event_id, user_id, case when event_id % 2 = 0 then 'search' else 'rec' end as scene, event_type as action,
  cast(json_extract_string(props, '$.k') as bigint) as note, ts, value, event_id // 5 as request from events)"""
