"""Training sets, vector cells, feeds and connectors' payloads, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cells, serving, training, vectors
from ..operators.relational import top_k
from ..sources import keyed
from ..sources.roles import BEH, IMP, REQ, behaviours, impressions, requests, table
from ..streaming.behaviour import overlaid
from .features import LAB, labelled, query
from .ranking import HIST, history
from .search import UQ, counted, seeds
from .serving import FINAL, final


@query(f"""with {REQ}, g as (select request, row_number() over (order by md5('42|' || request), request) as r, count(*) over () as n from req)
select request, r <= greatest(1, least(round(n * 0.2), n - 1)) as validation from g""")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return training.group_split(requests(spark, d), "request")


@query(f"""with {IMP}, r as (select request, item, click, row_number() over (partition by request, click > 0 order by position, item) as r from imp)
select request, item, click from r where click > 0 or r <= 1""")
def best_negatives(spark: SparkSession, d: str) -> DataFrame:
    return training.best_negatives(impressions(spark, d), "request", "click", "position", 1).select("request", "item", "click")


@query(f"""with {IMP}, {REQ}, x as (select user_id as u, item, max(click) as click, min(position) as position from imp join req using (request) group by 1, 2),
k as (select *, case when click > 0 then 'positive' when row_number() over (partition by u, click > 0 order by position, item) <= 7 then 'hard' else 'easy' end as kind from x),
p as (select *, row_number() over (partition by u, kind order by md5('42|' || u || '|' || item), item) as r, count(case when kind = 'hard' then 1 end) over (partition by u) as nh,
  count(case when kind = 'easy' then 1 end) over (partition by u) as ne from k),
q as (select *, least(ne, 9 - least(3, nh)) as easy from p)
select u as "user", item, kind from q where kind = 'positive' or (kind = 'hard' and r <= least(nh, 9 - easy)) or (kind = 'easy' and r <= easy)""")
def hard_and_easy_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d).join(requests(spark, d), "request").groupBy("user", "item").agg(F.max("click").alias("click"), F.min("position").alias("position"))
    return training.hard_and_easy(rows, "user", "click", "position", 9).select("user", "item", "kind")


@query(f"""with {IMP}, {LAB}, n as (select *, count(*) over w as n, max(y) over w as m, case when max(price) over w = min(price) over w then 0.0 else (price - min(price) over w) / (max(price) over w - min(price) over w + 1e-6) end as a,
 case when max(page_time) over w = min(page_time) over w then 0.0 else (page_time - min(page_time) over w) / (max(page_time) over w - min(page_time) over w + 1e-6) end as b from lab window w as (partition by request)),
t as (select request, item, y, step, round((1 - step / 20) * a + step / 20 * b, 9) as s from n, (select unnest(range(21)) as step) where n > 1 and m > 0),
o as (select *, row_number() over (partition by request, step order by s desc, item) as x, row_number() over (partition by request, step order by y desc, item) as z from t),
g as (select request, step, sum(case when x <= 10 then (pow(2, y) - 1) / log2(x + 1) else 0 end) / (sum(case when z <= 10 then (pow(2, y) - 1) / log2(z + 1) else 0 end) + 1e-9) as ndcg from o group by 1, 2)
select step / 20 as weight, round(avg(ndcg), 6) as ndcg from g group by 1""")
def blend_search(spark: SparkSession, d: str) -> DataFrame:
    found = training.blend_weights(labelled(spark, d), "request", "price", "page_time", "y")
    return found.select("weight", F.round("ndcg", 6).alias("ndcg"))


@query()
def cell_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50 among the cells probed, by exact inner products. Cells are learned, so there is no SQL; tests measure recall."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    index = cells.built(v, 16)
    return cells.searched(index, v.where("vec_id % 50 = 0").toDF("query_id", "q"), 10, 6)


@query(f"""with {IMP}, {REQ}, {HIST}, e as (select vec_id, cast(embedding as double[]) as v from embeddings), n as (select count(*) as n from e),
s as (select a.vec_id as src, b.vec_id as dst, list_dot_product(a.v, b.v) as score from e a, e b where a.vec_id <> b.vec_id),
nb as (select * from s qualify row_number() over (partition by src order by round(score, 9) desc, dst) <= 10),
h as (select u, rec, i % n.n as src from his, n), z as (select h.u, nb.dst, sum(nb.score / (1 + 0.35 * rec)) + 0.035 * (count(*) - 1) as score from h join nb using (src)
  where not exists (select 1 from h k where k.u = h.u and k.src = nb.dst) group by 1, 2)
select u as "user", dst as vec_id, round(score, 6) as score from z qualify row_number() over (partition by u order by round(score, 9) desc, dst) <= 20""")
def item_vector_recall(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of every vector that a history holds, searched in blocks."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    n = v.agg(F.count("*").alias("n"))
    h = history(spark, d).crossJoin(F.broadcast(n)).select("user", "recency", (F.col("item") % F.col("n")).alias("src"))
    asked = v.toDF("query_id", "q").join(h.select(F.col("src").alias("query_id")).distinct(), "query_id", "left_semi")
    near = vectors.blocked_top_k(asked, v, 10).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "score")
    return serving.neighbour_recall(h, near, 20).select("user", F.col("dst").alias("vec_id"), F.round("score", 6).alias("score"))


@query("""with m as (select vec_id, embedding as t, lead(embedding) over (order by vec_id) as nx from embeddings), f as (select vec_id, cast(t as double[]) as t, cast(case when vec_id % 3 <> 0 then nx end as double[]) as i from m)
select vec_id, list_transform(case when i is null then t else list_transform(list_zip(t, i), lambda p: 0.72 * p[1] + 0.28 * p[2]) end, lambda x: round(x, 6) + 0.0) as fused from f""")
def modal_fusion(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("t"))
    # The image of a vector is the next id's vector here; where ids end or divide by three there is none.
    image = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("t").alias("i")).where("vec_id % 3 <> 0")
    fused = vectors.fused(F.col("t"), F.col("i"))
    return v.join(image, "vec_id", "left").select("vec_id", F.transform(fused, lambda x: F.round(x, 6) + 0.0).alias("fused"))


@query(f"""with {UQ}, se as (select query, n, {seeds('query')} as t from cat), ty as (select query[1:4] as q, case when len(min(query)) % 3 = 0 then min(query) else query[1:4] end as m from cat where len(query) >= 4 group by 1), tt as (select q, m, {seeds('trim(m)')} as qt from ty),
x as (select q, m, query, n, starts_with(query, q) or starts_with(query, m) as s, contains(query, q) or contains(query, m) as c, len(list_intersect(qt, t)) / greatest(1, len(qt)) as o from tt, se where query <> m or q = m),
y as (select *, case when q = query or m = query then 18 else 0 end + case when s then 9 else 0 end + case when c then 2.4 else 0 end + 5.8 * o + 0.45 * ln(1 + n) - 0.05 * abs(len(query) - len(m)) as score, case when query = m then '纠错建议' when s then '热门补全' else '相关搜索' end as hint from x where s or c or o > 0),
z as (select q, query, score, n, hint from y union all select q, m, 20.0, coalesce(n, 0), '纠错建议' from ty left join cat on query = m where q <> m)
select q as typed, query, round(score, 6) as score, hint from z qualify row_number() over (partition by q order by round(score, 9) desc, n desc, len(query), query) <= 12""")
def query_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions for the first four characters of each query; some are corrected to a whole query."""
    c = counted(spark, d)
    typed = c.where(F.length("query") >= 4).groupBy(F.substring("query", 1, 4).alias("typed")).agg(F.min("query").alias("m"))
    meant = typed.select("typed", F.when(F.length("m") % 3 == 0, F.col("m")).alias("corrected"))
    return serving.suggestions(meant, c, 12).select("typed", "query", F.round("score", 6).alias("score"), "hint")


@query(f"""with {IMP}, {REQ}, r as (select * from req qualify row_number() over (partition by user_id order by ts desc, request desc) <= 3)
select user_id as "user", r.request, item from r join imp using (request) qualify row_number() over (partition by r.request order by click desc, price desc, item) <= 2""")
def recent_behaviours(spark: SparkSession, d: str) -> DataFrame:
    last = top_k(requests(spark, d), "user", [F.desc("ts"), F.desc("request")], 3).select("user", "request")
    rows = impressions(spark, d).join(last, "request")
    return top_k(rows, "request", [F.desc("click"), F.desc("price"), F.col("item")], 2).select("user", "request", "item")


@query(f"""with {IMP}, x as (select request, item, collect as exact, share * 0.5 as cover, "like" * 1.25 as lexical, click as intent, price / 10000 as base from imp),
a as (select *, exact = 1 or cover >= 0.45 or lexical >= 1.25 as strong, exact = 0 and cover < 0.34 as weak, exact = 0 and cover < 0.20 and lexical < 0.80 as hard from x),
s as (select *, base + 1.55 * exact + 0.32 * lexical + 1.60 * cover + 0.85 * strong::int + 0.42 * intent - 0.72 * weak::int - 2.20 * hard::int as score from a),
g as (select *, count(case when strong then 1 end) over (partition by request) as ns from s),
k as (select * from g where strong or (ns < 2 and (cover >= 0.24 or lexical >= 0.90)))
select request, item, round(score, 6) as score, row_number() over (partition by request order by strong desc, round(score, 9) desc, item) as rank from k""")
def lexical_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = impressions(spark, d).select(
        "request", "item", F.col("collect").alias("exact"), (F.col("share") * 0.5).alias("cover"), (F.col("like") * 1.25).alias("lexical"),
        F.col("click").alias("intent"), (F.col("price") / 10000).alias("base"),
    )
    return serving.lexical_gate(rows, 2).select("request", "item", F.round("score", 6).alias("score"), "rank")


@query(f"""with {IMP}, p as (select *, row_number() over (partition by request order by page_time desc, item) as pre from imp)
select round(avg(h), 6) as tail_hit, count(*) as n from (select request, max(case when position between 3 and 7 and pre <= 3 and click > 0 then 1 else 0 end) as h from p group by 1)""")
def tail_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    pre = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("page_time"), "item"))
    hit = F.when(F.col("position").between(3, 7) & (F.col("pre") <= 3) & (F.col("click") > 0), 1).otherwise(0)
    each = impressions(spark, d).withColumn("pre", pre).groupBy("request").agg(F.max(hit).alias("h"))
    return each.agg(F.round(F.avg("h"), 6).alias("tail_hit"), F.count("*").alias("n"))


@query(f"""with {IMP}, t as (select request, list(item order by position) filter (position % 4 = 3) as detail, list(item order by position) as result from imp group by 1)
select request, (case when len(detail) > 0 then detail else result end)[1:200] as truth from t""")
def truth_lists(spark: SparkSession, d: str) -> DataFrame:
    both = impressions(spark, d).groupBy("request").agg(
        F.collect_list(F.when(F.col("position") % 4 == 3, F.struct("position", "item"))).alias("a"), F.collect_list(F.struct("position", "item")).alias("b")
    )
    return both.select("request", training.truth_list(F.col("a"), F.col("b")).alias("truth"))


@query(f"""with {BEH}, x as (select user_id as u, scene, note, request, max(ts) as ts, max(event_id) as e, max_by(action, event_id) as action, max_by(value, event_id) filter (action = 'view') as page_time,
  max_by(event_id, event_id) filter (action = 'click') as clicked from beh where note is not null group by 1, 2, 3, 4)
select u as "user", scene, note, request, action, round(page_time, 6) as page_time, clicked, row_number() over (partition by u order by ts desc, e desc, scene, note, request) as place from x qualify place <= 60""")
def behaviour_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The last value of each field that an event has, not the last event's fields."""
    rows = behaviours(spark, d).where("note is not null").withColumns({"page_time": F.when(F.col("action") == "view", F.col("value")), "clicked": F.when(F.col("action") == "click", F.col("event_id"))})
    out = overlaid(rows, ["action", "page_time", "clicked"], ["user", "scene", "note", "request"], 60)
    return out.select("user", "scene", "note", "request", "action", F.round("page_time", 6).alias("page_time"), "clicked", "place")


@query(f"""with {FINAL}, {REQ}, {HIST}, r as (select fin.*, user_id as u from fin join req using (request)),
f as (select r.request, r.u, r.item, score - case when h.i is not null then 0.90 else 0 end as s from r left join (select distinct u, i from his) h on h.u = r.u and h.i = r.item),
k as (select *, row_number() over (partition by request order by round(s, 9) desc, item) as place from f)
select k.request, u as "user", k.item, place, round(s, 6) as final, imp.position as recall_rank, p_name as title, p_brand as brand from k join imp on imp.request = k.request and imp.item = k.item left join part on p_partkey = k.item where place > 0 and place <= 20""")
def feed_page(spark: SparkSession, d: str) -> DataFrame:
    ranked = final(spark, d).join(requests(spark, d), "request").select("request", "user", "item", "score")
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"))
    stages = impressions(spark, d).select("request", "item", F.col("position").alias("recall_rank"))
    page = serving.feed(ranked, history(spark, d), items, 1, 20).join(stages, ["request", "item"])
    return page.withColumn("final", F.round("final", 6))


@query(f"""with {REQ} select 'user:' || user_id as key, 'requests' as field, '[' || string_agg(request, ',' order by ts, request) || ']' as value from req group by user_id
union all select 'user:' || c_custkey, 'segment', '"' || c_mktsegment || '"' from customer""")
def key_value_payload(spark: SparkSession, d: str) -> DataFrame:
    lists = requests(spark, d).groupBy("user").agg(F.sort_array(F.collect_list(F.struct("ts", "request"))).alias("s")).select("user", F.col("s.request").alias("requests"))
    segments = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("segment"))
    return keyed.fields(lists, "user", "user").unionByName(keyed.fields(segments, "user", "user"))
