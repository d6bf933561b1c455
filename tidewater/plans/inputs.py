"""Scans, parsers, optional columns and stored tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, scoring, text
from ..operators import quota, routes, training
from ..sources import files
from ..sources.roles import IMP, impressions, table
from .features import LAB, labelled, query


@query("""select l_orderkey, l_linenumber, l_quantity from lineitem where l_partkey = 7 order by l_linenumber, l_orderkey, l_quantity limit 20""")
def pushed_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of one key; the condition and the columns reach the scan."""
    return files.ranked_rows(spark, f"{d}/lineitem.parquet", "l_partkey", 7, 20, ["l_orderkey", "l_linenumber", "l_quantity"], ("l_linenumber", "l_orderkey", "l_quantity"))


@query("""select column_name as name, case when column_name in ('request_idx', 'search_idx') then 1 else 0 end as request_key from (describe lineitem)""")
def column_list(spark: SparkSession, d: str) -> DataFrame:
    names = files.columns_of(spark, f"{d}/lineitem.parquet")
    key = files.request_key(names)
    return spark.createDataFrame([(n, int(n == key)) for n in names], "name string, request_key int")


@query(f"""with {IMP}, e as (select request, position, case when position = 3 then -item else item % 50 end as id, case when position % 4 = 0 then 1.0 when position = 5 then null else price end as score from imp),
f as (select * from e where position <= 6 and id >= 0 and score is not null)
select request, id, round(score, 6) as score from f qualify row_number() over (partition by request, id order by position) = 1""")
def nested_scored_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of [id, score] and bare [id]: ids below 0 and scores that are no numbers go, the first of repeated ids stays."""
    item = F.when(F.col("position") == 3, -F.col("item")).otherwise(F.col("item") % 50).cast("double")
    score = F.when(F.col("position") == 5, F.lit(float("nan"))).otherwise(F.col("price"))
    entry = F.when(F.col("position") % 4 == 0, F.array(item)).otherwise(F.array(item, score))
    g = impressions(spark, d).groupBy("request").agg(F.sort_array(F.collect_list(F.struct("position", entry.alias("e")))).alias("s"))
    return g.select("request", F.inline(parsing.nested_scores(F.col("s.e"), 6))).select("request", "id", F.round("score", 6).alias("score"))


@query(f"""with {IMP}, e as (select request, position, case when position = 2 then -item else item % 30 end as id from imp),
k as (select request, id, min(position) as p from e where id >= 0 group by 1, 2),
l as (select request, list(id order by p)[1:4] as ids from k group by 1)
select request, coalesce(ids, []) as ids, coalesce(ids, []) as printed from (select distinct request from imp) left join l using (request)""")
def result_id_lists(spark: SparkSession, d: str) -> DataFrame:
    """The distinct ids of a list, once nested and once printed."""
    item = F.when(F.col("position") == 2, -F.col("item")).otherwise(F.col("item") % 30)
    g = impressions(spark, d).groupBy("request").agg(F.sort_array(F.collect_list(F.struct("position", item.alias("i")))).alias("s"))
    printed = F.concat(F.lit("["), F.array_join(F.col("s.i").cast("array<string>"), ", "), F.lit("]"))
    return g.select("request", parsing.result_ids(F.col("s.i"), 4).alias("ids"), parsing.printed_ids(printed, 4).alias("printed"))


@query("""select vec_id % 100 as key, list_concat(list_transform(embedding, lambda x: cast(x as double))[1:(case when vec_id % 3 = 0 then 20 else 64 end)], list_transform(range(64), lambda x: 0.0::double))[1:32] as v
  from embeddings qualify row_number() over (partition by vec_id % 100 order by vec_id) = 1""")
def vector_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The first vector of each key, cut or filled to 32 numbers."""
    long = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 20)).otherwise(F.col("embedding"))
    return files.matrix(table(spark, d, "embeddings").select((F.col("vec_id") % 100).alias("key"), "vec_id", long.alias("v")), "key", "v", 32, ["vec_id"])


@query("""with v as (select p_type as v, row_number() over (order by p_type) - 1 as code from (select distinct p_type from part))
select '{' || string_agg('"' || v || '":' || code, ',' order by v) || '}' as vocabulary from v""")
def vocabulary_document(spark: SparkSession, d: str) -> DataFrame:
    return files.vocabulary_json(training.vocabulary(table(spark, d, "part"), "p_type"))


@query("""with f as (select p_type || '/' || p_partkey || '.jpg' as path from part where p_partkey % 3 <> 0),
e as (select p_partkey as item, unnest([p_type || '/' || p_partkey || '.jpg', p_type || '/' || (p_partkey + 1) || '.jpg', p_type || '/' || p_partkey || '.jpg']) as path, unnest([0, 1, 4]) as pos from part),
l as (select item, list(path order by pos) as images from e where path in (select path from f) group by 1)
select p_partkey as item, coalesce(images, []) as images from part left join l on item = p_partkey""")
def image_lists(spark: SparkSession, d: str) -> DataFrame:
    """Images that exist, of paths with and without the folder's name; paths that lead out of it go."""
    part, name = table(spark, d, "part"), lambda n: F.concat("p_type", F.lit("/"), n.cast("string"), F.lit(".jpg"))
    held = part.where("p_partkey % 3 <> 0").select(name(F.col("p_partkey")).alias("path"))
    own = name(F.col("p_partkey"))
    paths = F.array(F.concat(F.lit(" /image/"), own), name(F.col("p_partkey") + 1), F.concat(F.lit("../"), own), F.lit(None).cast("string"), F.concat(F.lit("image/"), own))
    return files.existing_images(part.select(F.col("p_partkey").alias("item"), paths.alias("paths")), "item", "paths", held).select("item", "images")


@query("""select count(*) as n_items, round(avg((p_size % 4 > 0)::int), 6) as with_image, (select count(*) from part where nullif(p_name, 'x') <> '' and p_size % 4 > 0) as n_shown from part""")
def item_coverage(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").withColumn("images", F.col("p_size") % 4)
    shown = files.shown_items(items, "p_name", "images").agg(F.count("*").alias("n_shown"))
    return files.coverage(items, "images").withColumn("with_image", F.round("with_image", 6)).crossJoin(F.broadcast(shown))


@query("""select vec_id % 100 as key, vec_id, label from embeddings qualify row_number() over (partition by vec_id % 100 order by vec_id desc) = 1""")
def last_shards(spark: SparkSession, d: str) -> DataFrame:
    """Of rows that several shards hold, that of the last shard."""
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 100).alias("key"), "vec_id", "label")
    return files.from_shards(rows, "key", "vec_id")


CATALOGUE = """ct as (select c_custkey as "user", count(o_orderkey) as n_requests from customer left join orders on o_custkey = c_custkey group by 1)"""


@query(f"""with {CATALOGUE}, a as (select "user", n_requests, 'page' as how from ct order by n_requests desc, "user" limit 20 offset 20), b as (select "user", n_requests, 'sample' as how from ct order by md5('5|' || "user"), "user" limit 20)
select * from a union all select * from b""")
def user_listing(spark: SparkSession, d: str) -> DataFrame:
    """A page of the catalogue of users, and a sample of it."""
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user")).agg(F.count("*").alias("n_requests"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user")).join(counts, "user", "left").withColumn("n_requests", F.coalesce("n_requests", F.lit(0)))
    return files.listed_users(users, 20, 20).withColumn("how", F.lit("page")).unionByName(files.listed_users(users, 20, seed=5).withColumn("how", F.lit("sample")))


ITEMS = """ir as (select item, count(*) as imp_num, sum(click) as click_num, sum("like") as rec_like_num, sum(collect) as rec_collect_num, sum(share) as rec_share_num, sum(page_time) as view_time,
  sum(case when position = 1 then page_time else 0 end) as rec_view_time, sum(case when click = 1 then page_time else 0 end) as valid_view_times from imp group by 1)"""


@query(f"""with {IMP}, {ITEMS} select item, round(click_num / imp_num, 6) as rec_ctr, round(coalesce(rec_like_num / nullif(click_num, 0), 0), 6) as rec_like_rate, round(coalesce(rec_collect_num / nullif(click_num, 0), 0), 6) as rec_collect_rate,
 round(coalesce(rec_share_num / nullif(click_num, 0), 0), 6) as rec_share_rate, 0.0::double as rec_follow_rate, round(coalesce(rec_view_time / nullif(view_time, 0), 0), 6) as rec_view_time_rate,
 round(coalesce(valid_view_times / nullif(view_time, 0), 0), 6) as valid_view_time_rate, 0.0::double as full_view_time_rate from ir""")
def scene_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of a scene's counters; some counters are missing."""
    c = F.col
    items = impressions(spark, d).groupBy("item").agg(
        F.count("*").alias("imp_num"), F.sum("click").alias("click_num"), F.sum("like").alias("rec_like_num"), F.sum("collect").alias("rec_collect_num"), F.sum("share").alias("rec_share_num"),
        F.sum("page_time").alias("view_time"), F.sum(F.when(c("position") == 1, c("page_time")).otherwise(0.0)).alias("rec_view_time"), F.sum(F.when(c("click") == 1, c("page_time")).otherwise(0.0)).alias("valid_view_times"),
    )
    return items.select("item", *(F.round(v, 6).alias(k) for k, v in scoring.scene_rates(items, "rec").items()))


@query("""select o_orderkey as request, o_orderdate as event_timestamp, o_totalprice as dense_feat1, o_custkey % 7 as dense_feat2 from orders""")
def event_times(spark: SparkSession, d: str) -> DataFrame:
    """The time of an event by the first column that rows have, and the columns of a pattern."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("dense_feat1"), (F.col("o_custkey") % 7).alias("dense_feat2"), "o_clerk" if "o_clerk" in table(spark, d, "orders").columns else F.lit(1).alias("other"))
    names = scoring.columns_like(rows, "dense_feat.*").columns
    return rows.select("request", scoring.event_time(rows, "rec"), *names)


@query(f"""with {IMP}, r as (select request, item, case position % 5 when 0 then 'ANN' when 1 then 'swing' when 2 then 'usercf' when 3 then 'hot' else 'other' end as route from imp)
select request, item, case lower(route) when 'ann' then 1 when 'swing' then 2 when 'usercf' then 3 when 'hot' then 4 else 0 end as number,
 case route when 'usercf' then 'bm25' when 'swing' then 'dpr' else route end as in_search, case route when 'swing' then 'seq' else route end as in_rec from r""")
def route_names(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("ANN", "swing", "usercf", "hot", "other")))
    route = F.col("route")
    rows = impressions(spark, d).withColumn("route", F.element_at(names, F.col("position") % 5 + 1))
    return rows.select("request", "item", scoring.route_number(route).alias("number"), quota.relabelled(route, "search").alias("in_search"), quota.relabelled(route, "rec").alias("in_rec"))


@query(f"""with {IMP}, x as (select request, item, case position % 6 when 0 then item || '.0' when 1 then 'x' || item when 2 then null when 3 then 'nan' when 4 then ' ' || item when 5 then item || '.75' end as v from imp)
select request, item, case when v is null or v = 'nan' then -1 else coalesce(cast(trunc(try_cast(trim(v) as double)) as bigint), -1) end as whole, round(case when v is null or v = 'nan' then 0 else coalesce(try_cast(trim(v) as double), 0) end, 6) as number from x""")
def safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Printed numbers as whole and as finite ones; what is none has a default."""
    i, at = F.col("item").cast("string"), F.col("position") % 6
    value = F.when(at == 0, F.concat(i, F.lit(".0"))).when(at == 1, F.concat(F.lit("x"), i)).when(at == 3, "nan").when(at == 4, F.concat(F.lit(" "), i)).when(at == 5, F.concat(i, F.lit(".75")))
    rows = impressions(spark, d).withColumn("v", value)
    return rows.select("request", "item", parsing.safe_int(F.col("v")).alias("whole"), F.round(scoring.number(F.col("v")), 6).alias("number"))


@query(f"""with {IMP}, x as (select request, string_agg(case when position % 3 = 0 then ' ' else '' end || (item % 5) || case when position % 4 = 0 then ' ' else '' end, ',' order by position) || ',, ' as t from imp group by 1),
y as (select request, list_filter(list_transform(string_split(t, ','), lambda v: trim(v)), lambda v: v <> '') as l from x)
select request, list_filter(l, lambda v, i: list_position(l, v) = i) as entries from y""")
def listed_entries(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("position")
    entry = F.concat(F.when(at % 3 == 0, " ").otherwise(""), (F.col("item") % 5).cast("string"), F.when(at % 4 == 0, " ").otherwise(""))
    g = impressions(spark, d).groupBy("request").agg(F.sort_array(F.collect_list(F.struct("position", entry.alias("e")))).alias("s"))
    return g.select("request", parsing.listed(F.concat(F.array_join("s.e", ","), F.lit(",, "))).alias("entries"))


@query(f"""with {IMP}, {LAB}, r as (select request, item % 9 - 1 as item, position as rank, y as score from lab), t as (select * from r qualify row_number() over (partition by request order by rank) <= 5)
select request, item, round(score, 6) as score from t where item >= 0 qualify row_number() over (partition by request, item order by rank desc) = 1""")
def score_maps(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the first rows by rank; of repeated items the last row counts."""
    rows = labelled(spark, d).select("request", (F.col("item") % 9 - 1).alias("item"), F.col("position").alias("rank"), F.col("y").alias("score"))
    return routes.last_scores(rows, 5).withColumn("score", F.round("score", 6))


@query("""with t as (select p_partkey as item, case when p_partkey % 4 = 0 then ' ' when p_partkey % 4 = 1 then null else p_name end as t, '看 #[' || replace(p_brand, '#', '') || ']# 和 #' || p_type || '[话题]# #[' || replace(p_brand, '#', '') || ']# #[x' || p_size || ']# #[y]#' as c from part)
select item, case when trim(coalesce(t, '')) <> '' then trim(t) when item % 8 = 1 then '(无标题)' else '(无标题) #' || (select replace(p_brand, '#', '') from part where p_partkey = item) || '[话题]# #' || (select p_type from part where p_partkey = item) || '[话题]# #x' || (select p_size from part where p_partkey = item) || '[话题]#' end as title from t""")
def shown_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles, and for items without one a placeholder with the first three topics of the content."""
    key = F.col("p_partkey")
    title = F.when(key % 4 == 0, " ").when(key % 4 != 1, F.col("p_name"))
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    topics = F.concat(F.lit("看 #["), brand, F.lit("]# 和 #"), "p_type", F.lit("[话题]# #["), brand, F.lit("]# #[x"), F.col("p_size").cast("string"), F.lit("]# #[y]#"))
    content = F.when(key % 8 != 1, topics)
    return table(spark, d, "part").select(key.alias("item"), text.shown_title(title, content).alias("title"))
