"""Linkage between scenes, chained routes, sequences and document search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import recall, serving
from ..operators.relational import top_k
from ..sources.roles import IMP, REQ, impressions, requests, table
from .features import TOKEN, query
from .ranking import HIST, history
from .search import UQ, counted, nq, pairs, seeds

PREF = "bp as (select u, p_brand as b, sum(1 / (1 + rec)) as w from his join part on p_partkey = i group by 1, 2), tg as (select u, list(b) as tags from (select * from bp qualify row_number() over (partition by u order by round(w, 9) desc, b) <= 3) group by 1)"


@query(f"""with {IMP}, {REQ}, {HIST}, {PREF}, kw as (select u, list(k order by rec, i) as kws from (select u, rec, i, string_split(p_name, ' ')[1] as k from his join part on p_partkey = i where rec < 4) group by 1)
select request, item, round((0.14 * len(list_filter(kws, lambda k: contains(lower(p_name), lower(k)))) + 0.06 * len(list_filter(kws, lambda k: contains(lower(p_type), lower(k))))
  + case when list_contains(tags, p_brand) then 0.06 else 0 end), 6) as boost from imp join req using (request) join part on p_partkey = item join kw on kw.u = user_id join tg on tg.u = user_id""")
def linkage_boost(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_type").alias("content"), F.col("p_brand").alias("tag_1"))
    seen = history(spark, d).join(part, "item")
    first = seen.where("recency < 4").groupBy("user").agg(F.sort_array(F.collect_list(F.struct("recency", "item", F.split("title", " ")[0].alias("k")))).alias("s"))
    tags = serving.preference_counts(seen, "tag_1", 3).groupBy("user").agg(F.collect_list("tag_1").alias("tags"))
    rows = impressions(spark, d).join(requests(spark, d), "request").select("request", "user", "item").join(part, "item")
    rows = rows.join(first.select("user", F.col("s.k").alias("kws")), "user").join(tags, "user")
    return rows.select("request", "item", F.round(serving.linkage_boosts(rows, F.col("kws"), F.col("tags"), False), 6).alias("boost"))


RS = "a0 as (select request, item, floor(price) / 100000 as s from imp where position % 2 = 1), b0 as (select request, item, page_time / 50 as s from imp where position % 3 <> 0), c0 as (select request, item, click * 0.5 + 0.1 as s from imp where position <= 4)"


def _routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = impressions(spark, d)
    pick = lambda where, score: rows.where(where).select("request", "item", score.alias("score"))
    return pick("position % 2 = 1", F.floor("price") / 100000), pick("position % 3 <> 0", F.col("page_time") / 50), pick("position <= 4", F.col("click") * 0.5 + 0.1)


@query(f"""with {IMP}, {RS}, x as (select request, item, sum(s) + case when count(*) > 1 then 0.16 else 0 end as s from (select * from a0 union all select request, item, 0.82 * s from b0) group by 1, 2),
x2 as (select * from x qualify row_number() over (partition by request order by round(s, 9) desc, item) <= 5),
y as (select request, item, sum(s) + case when count(*) > 1 then 0.10 else 0 end as s from (select * from x2 union all select request, item, 0.36 * s from c0) group by 1, 2)
select request, item, round(s, 7) as score from y qualify row_number() over (partition by request order by round(s, 9) desc, item) <= 5""")
def route_chain(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = _routes(spark, d)
    return recall.chained(a, [(b, 0.82, 0.16), (c, 0.36, 0.10)], 5).withColumn("score", F.round("score", 7))


@query(f"""with {IMP}, {RS}, n as (select request, item, case when max(s) over w = min(s) over w then 1.0 else (s - min(s) over w) / (max(s) over w - min(s) over w) end as s from b0 window w as (partition by request))
select coalesce(a0.request, n.request) as request, coalesce(a0.item, n.item) as item, round(0.68 * coalesce(a0.s, 0) + 1.18 * coalesce(n.s, 0), 7) as score from a0 full join n on a0.request = n.request and a0.item = n.item""")
def semantic_rescore(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _routes(spark, d)
    return recall.semantic_rescored(a, b).withColumn("score", F.round("score", 7))


@query(f"""with {IMP}, r as (select * from imp where position <= 6 and position > 2 and click = 0)
select request, list(item order by position, item) as items from (select * from r qualify row_number() over (partition by request order by position, item) <= 2) group by 1""")
def complement_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d)
    return recall.complement_negatives(rows.select("request", "item", F.col("position").alias("rank")), rows.where("position <= 2"), rows.where("click > 0"), 6, 2)


@query(f"""with {IMP}, {REQ}, {HIST}, e as (select vec_id, cast(embedding as double[]) as v from embeddings where vec_id % 5 <> 0), n as (select count(*) as n from embeddings),
h as (select u, rec, i % n.n as vec_id from his, n), k as (select u, v, row_number() over (partition by u order by rec, vec_id) as r from h join e using (vec_id)),
g as (select u, list(v order by r) as f from k where r <= 20 group by 1)
select u as "user", coalesce(len(f), 0) as n, list_concat(coalesce(f, []), list_transform(range(20 - coalesce(len(f), 0)), lambda j: list_transform(range(64), lambda m: 0.0::double))) as sequence from (select distinct u from h) left join g using (u)""")
def history_sequences(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    h = history(spark, d).crossJoin(F.broadcast(n)).select("user", "recency", (F.col("item") % F.col("n")).alias("vec_id"))
    v = e.where("vec_id % 5 <> 0").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return serving.padded_sequences(h, v, 20, 64)


@query("""with t as (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as s from customer where c_custkey % 5 <> 0)
select c_custkey as "user", round(case when s < 1e-6 then 0 else (c_acctbal - m) / (s + 1e-6) end, 6) as z from customer, t""")
def fitted_z_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_acctbal").alias("z"))
    return serving.fitted_z_scores(rows, rows.where("user % 5 <> 0"), ["z"]).withColumn("z", F.round("z", 6))


@query(f"""with {UQ}, ti as (select i.item_id, {nq("substr(i.text, 1, 60)")} as t, {nq("i.text")} as c from benchmark i),
x as (select query, item_id, t, c, {seeds('query')} as qt, {pairs('query')} as g from cat, ti), h as (select * from x where len(list_filter(qt, lambda k: list_contains(regexp_extract_all(c, '{TOKEN}'), k))) > 0),
s as (select query, item_id, case when contains(t, query) then 3.2 else 0 end + case when contains(c, query) then 1.0 else 0 end
 + 1.4 * len(list_intersect(g, {pairs('t')})) / greatest(1, len(g)) + 0.35 * len(list_intersect(g, {pairs('substr(c, 1, 500)')})) / greatest(1, len(g))
 + 1.7 * len(list_filter(qt, lambda k: contains(t, k))) / greatest(1, len(qt)) + 0.55 * len(list_filter(qt, lambda k: contains(c, k))) / greatest(1, len(qt)) as s from h)
select query, item_id, round(s, 6) as score from s""")
def item_search(spark: SparkSession, d: str) -> DataFrame:
    """Every query of the catalogue against the items that hold a term of its, found by an inverted index."""
    plain = text.normalized
    items = table(spark, d, "benchmark").select("item_id", plain(F.substring("text", 1, 60)).alias("t"), plain(F.col("text")).alias("c"))
    index = items.select("item_id", F.explode(F.array_distinct(text.tokens(F.col("c")))).alias("term"))
    met = counted(spark, d).select("query").withColumn("term", F.explode(text.seed_terms(F.col("query")))).join(index, "term").select("query", "item_id").distinct()
    return met.join(items, "item_id").select("query", "item_id", F.round(text.search_score(F.col("query"), F.col("t"), F.col("c")), 6).alias("score"))


@query(f"""with {IMP}, {REQ}, p as (select request, item, position, case when collect = 1 then 0 else 1 end as other from imp)
select request, item, row_number() over (partition by request order by other, position) as place from p qualify place > 1 and place <= 3""")
def preferred_first(spark: SparkSession, d: str) -> DataFrame:
    placed = top_k(impressions(spark, d), "request", [F.desc("collect"), F.col("position")], 3, "place")
    return placed.where("place > 1").select("request", "item", "place")
